"""Quad-trees over planes of blocks: sums roll up level by level on quad keys, choices go back down by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import total

#: Cells of a block's side.
N = 8


def leaves(blocks: DataFrame) -> DataFrame:
    """(frame, r, c, n, s, ss): cells, their sum and sum of squares for each block (frame, r, c, b)."""
    return blocks.select("frame", "r", "c", F.size("b").cast("bigint").alias("n"), total(F.col("b")).alias("s"), total(F.transform("b", lambda x: x * x)).alias("ss"))


def rolled_up(blocks: DataFrame, levels: int) -> list[DataFrame]:
    """(frame, r, c, n, s, ss) at each level; a node's place is its blocks' place, shifted by one bit a level.

    Each level is a grouping of the one below, a quarter of its rows, which are summed up before they are shuffled.
    """
    out = [leaves(blocks)]
    for _ in range(levels):
        up = out[-1].groupBy("frame", F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c"))
        out.append(up.agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss"))))
    return out


def best_partition(blocks: DataFrame, levels: int, signal: int) -> DataFrame:
    """(frame, level, r, c, n, cost): the nodes of the cheapest partition of each plane.

    A whole node costs its cells' squared distances from their mean (n times the variance, rounded down); split, what its parts
    cost and ``signal``. Nodes are split where that costs less, or where blocks are missing. Upwards a node's cost is
    the sum of its parts' best ones; downwards a node stands if all above it are split.
    """
    level = leaves(blocks).withColumn("cost", F.expr("ss - (s * s) div n")).withColumn("split", F.lit(False))
    tree = [level]
    for k in range(1, levels + 1):
        up = tree[-1].groupBy("frame", F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c"))
        up = up.agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss")), F.sum("cost").alias("parts"))
        whole = F.expr("ss - (s * s) div n")
        split = (F.col("parts") + signal < whole) | (F.col("n") < (N << k) ** 2)
        up = up.withColumn("split", split).withColumn("cost", F.when(F.col("split"), F.col("parts") + signal).otherwise(whole))
        tree.append(up.select("frame", "r", "c", "n", "s", "ss", "cost", "split"))
    chosen, above = [], None
    for k in range(levels, -1, -1):
        nodes = tree[k]
        if above is not None:
            nodes = nodes.withColumns({"pr": F.shiftright("r", 1), "pc": F.shiftright("c", 1)}).join(above, ["frame", "pr", "pc"], "left_semi").drop("pr", "pc")
        chosen.append(nodes.filter("NOT split").select("frame", F.lit(k).alias("level"), "r", "c", "n", "cost"))
        above = nodes.filter("split").select("frame", F.col("r").alias("pr"), F.col("c").alias("pc"))
    return reduce(DataFrame.unionByName, chosen)
