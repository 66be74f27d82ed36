"""Exact quantiles of long columns by digit descent: histograms of a few bits at a time, never a list of values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a digit: a histogram has 2^DIGIT rows at most, whatever the rows behind it.
DIGIT, BITS = 16, 64


def _key(value: Column) -> Column:
    """A long whose bits, taken as unsigned, are in the order of the values."""
    return value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def _rank(q: float, n: int) -> int:
    """Place of the quantile among n values, from 1: the least with at least q of all at or below it."""
    return max(1, -(-round(q * n * 10**9) // 10**9))


def exact_quantile(df: DataFrame, value: Column, q: float) -> int | None:
    """The least value with at least ``q`` of all values at or below it; None if there are none. Nulls don't count.

    Four passes: each counts the next digit of the values that share the digits found so far. Counts are summed up by task, and
    at most 2^16 of them meet in the task that finds the digit where the rank falls.
    """
    keys = df.select(_key(value).alias("k")).filter("k IS NOT NULL")
    n = keys.count()
    if not n:
        return None
    rank, prefix = _rank(q, n), 0
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        known = keys if shift == BITS - DIGIT else keys.filter(F.shiftrightunsigned("k", shift + DIGIT) == prefix)
        digit = F.shiftrightunsigned("k", shift).bitwiseAND((1 << DIGIT) - 1)
        counts = known.groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("digit")))
        found = upto.filter(F.col("upto") >= rank).orderBy("digit").first()
        rank -= found["upto"] - found["n"]
        prefix = prefix << DIGIT | found["digit"]
    return (prefix ^ (1 << 63)) - ((prefix ^ (1 << 63)) >> 63 << 64)


#: Groups up to which a row for each is broadcast in every pass.
BROADCAST_GROUPS = 1 << 16


def exact_quantiles(df: DataFrame, by: list[str], value: str, q: float, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(by, value): ``exact_quantile`` of each group that has values; a null in ``by`` is a group as any other.

    Four passes. In each, rows meet the digits found so far of their group where they lie, and counts are summed up by task: a row
    is never shuffled or sorted, however large its group. The digits found, one row a group, are broadcast up to
    ``broadcast_groups`` groups; more meet their rows in a merge join, whose hot groups are left to Spark's skew join.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, _key(F.col(value)).alias("k"))
    few = rows.select(*by).distinct().limit(broadcast_groups + 1).count() <= broadcast_groups
    order, found = Window.partitionBy(*by).orderBy("digit"), None
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("k", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")
        if found is None:
            counts = rows.groupBy(*by, digit).agg(F.count("*").alias("n"))
            rank = F.greatest(F.lit(1), F.ceil(F.round(F.sum("n").over(Window.partitionBy(*by)) * q, 9)))
            counts = counts.withColumns({"rank": rank, "prefix": F.lit(0).cast("bigint")})
        else:
            known = found.select(*(F.col(c).alias(f"found_{c}") for c in by), "rank", "prefix")
            same = [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in by]
            met = rows.join(F.broadcast(known) if few else known.hint("merge"), reduce(and_, same, F.shiftrightunsigned("k", shift + DIGIT) == F.col("prefix")))
            counts = met.groupBy(*by, digit).agg(F.count("*").alias("n"), F.first("rank").alias("rank"), F.first("prefix").alias("prefix"))
        upto = counts.withColumn("upto", F.sum("n").over(order))
        first = upto.filter("upto >= rank").groupBy(*by).agg(F.min(F.struct("digit", "upto", "n", "rank", "prefix")).alias("x"))
        found = first.select(*by, F.expr("x.rank - (x.upto - x.n)").alias("rank"), F.call_function("shiftleft", F.col("x.prefix"), F.lit(DIGIT)).bitwiseOR(F.col("x.digit")).alias("prefix"))
    return found.select(*by, _key(F.col("prefix")).alias(value))
