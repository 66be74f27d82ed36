"""Loading the tables, and the grids that block operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a block; the scale at which its floats become integers.
SIDE, SCALE = 8, 1024


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, b): each vector as an 8 x 8 block of integers, by rows."""
    return embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE + 0.5)).alias("b"))


def cells(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, r, c, v): one row for each cell of each block."""
    flat = blocks(embeddings).select("vec_id", "label", F.posexplode("b").alias("i", "v"))
    return flat.select("vec_id", "label", F.expr("i div 8").alias("r"), (F.col("i") % SIDE).cast("bigint").alias("c"), "v")
