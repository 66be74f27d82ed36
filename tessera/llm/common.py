"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: where tables go when a session on one machine names no shared folder (tests).
LOCAL_SHARED = "/tmp/tessera-shared"

#: Bytes of texts that a Python worker of the pipeline gets at a time: Spark's own 10,000 rows hold tens of MB on both sides.
TEXT_BATCH = 1 << 20

#: Fixed value: ASCII white space as the word rules define it, for a character class.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one is set.

    Only if all runs on one machine: on a cluster, executors would write what others can't read, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SHARED)
        found = LOCAL_SHARED
    return found.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """While it lasts, the rows of queries that begin go to Python workers in batches of about ``most`` bytes; None: as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if most:
        spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def giving_back(each: Callable) -> Callable:
    """``each``, a function for mapInArrow, after whose last batch the worker's free memory returns to the system.

    Workers are used again and wait for that: what one of them keeps, no other and no JVM can have.
    """

    @wraps(each)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return run


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back; ``batch_bytes``: of ``arrow_batches``.

    Cuts the lineage: a lost executor never makes Spark repeat what produced the table. Results that are read later
    still need it, so it is deleted when the session's application ends.
    """
    with arrow_batches(df.sparkSession, batch_bytes):
        return stored_at(df, name)[0]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the table's path for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more: what was made of it is stored itself."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; none for a null text.

    Plain replacements and a split on one character: several times faster than a split on a pattern.
    """
    text = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")
