"""Slots as a state processor: equal to a batch, across a restart; idle slots are emptied; batches write what they change."""

from pyspark.sql import functions as F

from tessera.streaming import slots

from .conftest import SF


def prepared(events):
    return events.select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 37 % 256).alias("mask"))


def batch_slots(events):
    each = prepared(events).withColumn("slot", F.explode(F.array_compact(F.array(*(F.when(F.shiftright("mask", k).bitwiseAND(1) == 1, F.lit(k)) for k in range(8))))))
    last = each.groupBy("user_id", "slot").agg(F.count("*").alias("n_writes"), F.max(F.struct("event_id", "value")).alias("x"), F.max("ts").alias("newest"))
    return last.select("user_id", "slot", "n_writes", "x.event_id", "x.value", "newest")


def test_restarts_equal_a_batch_and_changes_are_few(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    place, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    bounds = [r["event_id"] for r in events.orderBy("event_id").select("event_id").collect()]
    cuts = [0, len(bounds) // 2, len(bounds) - 5, len(bounds)]
    got = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        events.filter(F.col("event_id").between(bounds[a], bounds[b - 1])).coalesce(1).write.mode("append").parquet(place)
        got = slots.run_refreshes(spark, place, checkpoint, "t", prepared, "4000 days")  # each call a restart
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r)[:5] for r in batch_slots(events).collect())
    counts = {r["batch"]: r["count"] for r in spark.read.parquet(f"{checkpoint}-t").groupBy("batch").count().collect()}
    assert min(counts.values()) <= 5 * 8  # five events change 40 slots at most


def test_idle_slots_are_emptied(spark, tmp_path):
    def event(i, user, at, mask):
        return spark.createDataFrame([(i, user, float(i), at, mask)], "event_id long, user_id long, value double, ts string, mask int")

    place, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    given = [event(1, 7, "2024-01-01 00:00:00", 3), event(2, 7, "2024-01-03 00:00:00", 2), event(3, 8, "2024-01-03 12:00:00", 1), event(4, 8, "2024-01-03 12:30:00", 1)]
    for e in given:
        e.coalesce(1).write.mode("append").parquet(place)
        got = slots.run_refreshes(spark, place, checkpoint, "t", lambda df: df.withColumn("ts", F.to_timestamp("ts")), "1 day")
    assert sorted((r["user_id"], r["slot"], r["n_writes"], r["last_event"]) for r in got.collect()) == [(7, 1, 2, 2), (8, 0, 2, 4)]
