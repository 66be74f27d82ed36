"""Operators on grids of blocks: neighbours and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_neighbours(df: DataFrame, frame: str, row: str, col: str, values: list[str]) -> DataFrame:
    """Adds ``<value>_up``, ``<value>_left`` and ``<value>_up_left``: those of the blocks beside each one; null at an edge.

    A frame's blocks are ordered twice, by column and by row; frames are what is spread over tasks.
    """
    down, across = Window.partitionBy(frame, col).orderBy(row), Window.partitionBy(frame, row).orderBy(col)
    df = df.withColumns({f"{v}_up": F.lag(v).over(down) for v in values})
    return df.withColumns({f"{v}_left": F.lag(v).over(across) for v in values} | {f"{v}_up_left": F.lag(f"{v}_up").over(across) for v in values})


def segment_prediction(up: Column, left: Column, up_left: Column) -> tuple[Column, Column]:
    """(prediction, context): up if up and up-left agree, else left; how many of the three agree (none: 0, two: 1, all: 2)."""
    prediction = F.when(up_left == up, up).otherwise(F.coalesce(left, up, F.lit(0)))
    pairs = (up_left == up).cast("int") + (up_left == left).cast("int") + (up == left).cast("int")
    context = F.when(up_left.isNull(), 0).when(pairs == 3, 2).when(pairs > 0, 1).otherwise(0)
    return prediction, context


def reference_counts(pairs: list[tuple[Column, Column]], frames: int) -> Column:
    """Array of how often each frame is used by some neighbours (first, second); a null or 0 first one counts nothing."""
    used = lambda f: sum(((a > 0) & (a == f)).cast("int") + ((a > 0) & (b > 0) & (b == f)).cast("int") for a, b in ((F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))) for a, b in pairs))
    return F.array(*(used(f).cast("bigint") for f in range(frames)))


def present(*flags: Column) -> Column:
    """How many of some neighbours exist and have a flag."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags[1:]), F.coalesce(flags[0].cast("int"), F.lit(0)))


def merged_stats(df: DataFrame, by: list[str], rate: str, dist: str, skip: str, most: int = 2**31 - 1) -> DataFrame:
    """(*by, rate, dist, skip): sums of a group's rates, ``most`` at most and if any is; of the distances; all skip.

    Sums with one absorbing value, so partial sums are made before the shuffle.
    """
    invalid = F.bool_or(F.col(rate) >= most)
    total = F.least(F.sum(F.when(F.col(rate) < most, F.col(rate)).otherwise(0)), F.lit(most))
    return df.groupBy(*by).agg(F.when(invalid, F.lit(most)).otherwise(total).cast("bigint").alias("rate"), F.sum(dist).alias("dist"), F.bool_and(skip).alias("skip"))


def selected_samples(df: DataFrame, by: str, order: str, distance: Column, limit: Column, most: int) -> DataFrame:
    """(by, n, n_far): a group's first ``most`` samples within ``limit``, and its first one whatever its distance."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    near = df.withColumn("_near", distance <= limit).withColumn("_at", place).filter(F.col("_near") | (F.col("_at") == 1))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_at"))).filter(F.col("_n") <= most)
    return near.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("_near")).alias("n_far"))
