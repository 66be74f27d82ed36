"""Slot state over a stream: each of a user's eight slots holds what was last written to it.

``run_stream`` keeps it as a running aggregate, ``run_refreshes`` as a state processor: an event refreshes all slots of its
bitmask, and a slot that no event has refreshed for some time is emptied by a timer. Either way a batch writes the slots
that it changed and nothing else, in a folder of its own, which a batch that is run again writes again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 8
CHANGES = "user_id bigint, slot int, n_writes bigint, last_event bigint, last_value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def slot_state(events: DataFrame) -> DataFrame:
    """(user_id, slot, n_writes, last_event, last_value); for a batch or, as running state, for a stream."""
    rows = events.withColumn("slot", (F.col("event_id") % SLOTS).cast("int"))
    last = rows.groupBy("user_id", "slot").agg(F.count("*").alias("n_writes"), F.max(F.struct("event_id", "value")).alias("x"))
    return last.select("user_id", "slot", "n_writes", F.col("x.event_id").alias("last_event"), F.col("x.value").alias("last_value"))


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder as a stream, a file a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(changes: DataFrame, checkpoint: str, table: str) -> DataFrame:
    """Runs a stream of changed slots to its end; the state of all slots after it, those of earlier runs included."""
    spark, place = changes.sparkSession, f"{checkpoint.rstrip('/')}-{table}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/batch={batch}")

    query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.schema(f"{CHANGES}, batch bigint").parquet(place))


def latest(changes: DataFrame) -> DataFrame:
    """The state after some batches' changes (with batch): each slot's last one; slots that were emptied are none."""
    last = changes.groupBy("user_id", "slot").agg(F.max_by(F.struct("n_writes", "last_event", "last_value"), "batch").alias("x"))
    return last.select("user_id", "slot", "x.*").filter("n_writes > 0")


def run_stream(spark: SparkSession, path: str, checkpoint: str, table: str) -> DataFrame:
    """``slot_state`` after all files in the folder ``path`` have been read as a stream; it goes on where the checkpoint ends."""
    return _run(slot_state(_stream(spark, path)), checkpoint, table)


class SlotProcessor(StatefulProcessor):
    """A user's slots: an event (event_id, value, mask, at_ms) is written to every slot whose bit is set in its mask.

    The event with the greatest event_id stays, in whatever order events come. A slot is emptied when the watermark
    passes its newest event by ``idle_ms``; it has one timer, moved on when it fires too early.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", "n_writes bigint, last_event bigint, last_value double, newest_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held: dict[int, tuple] = {}
        for r in rows:
            for slot in range(SLOTS):
                if r["mask"] >> slot & 1:
                    if slot not in held:
                        held[slot] = tuple(self.slots.getValue((slot,))) if self.slots.containsKey((slot,)) else (0, None, None, None)
                    n, event, value, newest = held[slot]
                    if event is None or r["event_id"] > event:
                        event, value = r["event_id"], r["value"]
                    held[slot] = (n + 1, event, value, max(newest or r["at_ms"], r["at_ms"]))
        for at in {x[3] + self.idle_ms for x in held.values()}:
            self.handle.registerTimer(at)
        for slot, x in sorted(held.items()):
            self.slots.updateValue((slot,), x)
            yield Row(user_id=key[0], slot=slot, n_writes=x[0], last_event=x[1], last_value=x[2])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (slot,), x in list(self.slots.iterator()):
            if x[3] + self.idle_ms <= now:
                self.slots.removeKey((slot,))
                yield Row(user_id=key[0], slot=slot, n_writes=0, last_event=None, last_value=None)

    def close(self) -> None:
        pass


def refreshed(events: DataFrame, idle: str, late: str = "2 hours") -> DataFrame:
    """Changed slots (``CHANGES``) of a stream of events (user_id, event_id, value, ts: timestamp, mask); n_writes 0: emptied."""
    idle_ms = F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {idle})")
    n = events.sparkSession.range(1).select(idle_ms.alias("n")).first()["n"]
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "value", "ts", F.col("mask").cast("int").alias("mask"), F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("user_id").transformWithState(SlotProcessor(n), CHANGES, "Update", "EventTime")


def run_refreshes(spark: SparkSession, path: str, checkpoint: str, table: str, prepared: Callable[[DataFrame], DataFrame], idle: str) -> DataFrame:
    """The slots after all files in the folder ``path``, as events that ``prepared`` makes of their rows; goes on where the checkpoint ends."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return _run(refreshed(prepared(_stream(spark, path)), idle), checkpoint, table)
    finally:
        spark.conf.set(PROVIDER, before)


def hourly_totals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling hours with a watermark for late rows; ``ts`` is a timestamp."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
