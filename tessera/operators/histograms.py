"""Histograms, distinct values, top values and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(*by, value, n)."""
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))


def dual_histogram(df: DataFrame, value: Column, bits: int) -> DataFrame:
    """(bin, n, n_distinct): bins of 2^bits values, from the fine histogram so that rows are shuffled once, summed up."""
    fine = histogram(df, value)
    return fine.groupBy(F.shiftright("value", bits).alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


def top_values(df: DataFrame, value: Column, by: str, k: int) -> DataFrame:
    """(by, rank, value, n): the k most frequent values of each group, ties to the smaller value."""
    order = Window.partitionBy(by).orderBy(F.desc("n"), "value")
    return histogram(df, value, by).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(by, "rank", "value", "n")


def sorted_distinct(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n_values, values): each group's distinct values, ascending, joined by commas."""
    few = df.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("a"))
    return few.select(by, F.size("a").cast("bigint").alias("n_values"), F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("values"))


def counters(df: DataFrame, metric: str, key: Column) -> DataFrame:
    """(metric, key, n)."""
    return df.groupBy(F.lit(metric).alias("metric"), key.alias("key")).agg(F.count("*").alias("n"))


def symbol_costs(df: DataFrame, symbol: str, by: str, scale: int = 512) -> DataFrame:
    """(by, n, cost): cost of each group's symbols at -log2 of their share in all rows, in 1/scale bits.

    Counts of (group, symbol) are all that is joined.
    """
    counts = df.groupBy(by, symbol).agg(F.count("*").alias("n"))
    totals = counts.groupBy(symbol).agg(F.sum("n").alias("of_symbol"))
    total = F.sum("of_symbol").over(Window.partitionBy()).cast("double")  # over one row a symbol
    totals = totals.withColumn("bits", F.floor(-F.log2(F.col("of_symbol") / total) * scale + 0.5))
    return counts.join(totals, symbol).groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bits")).alias("cost"))
