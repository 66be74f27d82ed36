"""Ordered operators: offsets, deltas, folds, last writers, edges, products at lags, binned moments, resampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import div


def offsets(df: DataFrame, key: str, size: str, group: int, levels: int = 2) -> DataFrame:
    """Adds ``offset``: the sizes of all rows with a smaller key. Ranges of ``group`` keys are summed up first, then
    ranges of ``group`` ranges and so forth, so that only the last sums, one for each ``group`` ^ ``levels`` keys, are ever
    in one partition."""
    if not levels:
        return df.withColumn("offset", F.sum(size).over(Window.orderBy(key)) - F.col(size))
    at = f"_range{levels}"
    df = df.withColumn(at, div(F.col(key), group))
    sums = offsets(df.groupBy(at).agg(F.sum(size).alias("_n")), at, "_n", group, levels - 1).select(at, F.col("offset").alias("_before"))
    own = F.sum(size).over(Window.partitionBy(at).orderBy(key)) - F.col(size)
    return df.withColumn("_own", own).join(sums, at).withColumn("offset", F.col("_before") + F.col("_own")).drop(at, "_own", "_before")


def deltas(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, delta): distinct values of each group with the difference from the one before (first: itself)."""
    once = df.select(by, value).distinct()
    return once.withColumn("delta", (F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(by).orderBy(value)), F.lit(0))).cast("bigint"))


def adapted_probabilities(df: DataFrame, by: list[str], order: str, symbol: str, symbols: int) -> DataFrame:
    """(*by, n, e0, e1, ...): cumulative probabilities (of 32768) after coding each group's symbols in order.

    Entries below a coded symbol move toward 32768, the others toward 0, by their distance >> rate; the rate is 4, one
    more for over three symbols, and one more for every 16 symbols coded, of which 32 count. Each step needs the one
    before, so a group is one task's, but as a stream of sorted rows: only its probabilities are held.
    """
    start = [32768 - 32768 * (i + 1) // symbols for i in range(symbols - 1)]
    names = [*by, "n", *(f"e{i}" for i in range(symbols - 1))]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{name}` {kinds[name]}" for name in by), "n long", *(f"e{i} long" for i in range(symbols - 1))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, e, done = None, 0, start, []
        for batch in batches:
            keys, coded = zip(*(batch.column(name).to_pylist() for name in by), strict=True), batch.column("_symbol").to_pylist()
            for key, x in zip(keys, coded, strict=True):
                if key != group:
                    if n:
                        done.append((*group, n, *e))
                    group, n, e = key, 0, start
                rate = 4 + (symbols > 3) + (min(n, 32) >> 4)
                e, n = [p + (32768 - p >> rate) if i < x else p - (p >> rate) for i, p in enumerate(e)], n + 1
            if len(done) > 10_000:
                yield out(done)
                done = []
        if n:
            done.append((*group, n, *e))
        if done:
            yield out(done)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    rows = df.select(*by, F.col(order).alias("_at"), F.col(symbol).cast("int").alias("_symbol"))
    return rows.repartition(*by).sortWithinPartitions(*by, "_at", "_symbol").drop("_at").mapInArrow(fold, schema)


def clamped_sums(df: DataFrame, by: list[str], order: str, step: str, start: int, low: int, high: int, group: int = 4096) -> DataFrame:
    """(*by, n, carry): ``start`` plus each group's steps in order, held within ``low`` and ``high`` after each.

    x -> clamp(x + a, l, h), once after another, is of that form again. So ranges of ``group`` values of ``order`` are
    folded for themselves, and a group's few results after that: no row holds more of it than one range.
    """
    whole = lambda x: F.struct(x["a"].alias("a"), x["l"].alias("l"), x["h"].alias("h"))
    then = lambda f, g: F.struct((f["a"] + g["a"]).alias("a"), F.least(F.greatest(f["l"] + g["a"], g["l"]), g["h"]).alias("l"), F.least(F.greatest(f["h"] + g["a"], g["l"]), g["h"]).alias("h"))
    fold = lambda s: F.aggregate(F.slice(s, 2, F.size(s)), whole(s[0]), lambda f, g: then(f, g))
    wide = lambda x: F.lit(x).cast("bigint")
    rows = df.select(*by, F.struct(F.col(order).alias("at"), F.col(step).cast("bigint").alias("a"), wide(low).alias("l"), wide(high).alias("h")).alias("f"), div(F.col(order), group).alias("_range"))
    ranges = rows.groupBy(*by, "_range").agg(F.count("*").alias("n"), fold(F.sort_array(F.collect_list("f"))).alias("f"))
    whole_groups = ranges.groupBy(*by).agg(F.sum("n").alias("n"), fold(F.sort_array(F.collect_list(F.struct("_range", "f.a", "f.l", "f.h")))).alias("f"))
    return whole_groups.select(*by, "n", F.least(F.greatest(F.lit(start) + F.col("f.a"), F.col("f.l")), F.col("f.h")).alias("carry"))


def candidate_stack(df: DataFrame, by: str, key: str, weight: str, arrival: str, most: int, near: int, bonus: int) -> DataFrame:
    """(by, rank, key, weight): a group's first ``most`` distinct keys with their summed weights.

    Keys that arrive up to ``near`` get the bonus and stand first; within either part heavier keys, then earlier ones.
    """
    stack = df.groupBy(by, key).agg(F.sum(weight).alias("w"), F.min(arrival).alias("at"))
    first = Window.partitionBy(by).orderBy("at", key)
    stack = stack.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    nearby = F.col("at") <= near
    stack = stack.withColumn("w", F.col("w") + F.when(nearby, F.lit(bonus)).otherwise(F.lit(0))).withColumn("far", ~nearby)
    order = Window.partitionBy(by).orderBy("far", F.desc("w"), "at", key)
    return stack.select(by, F.row_number().over(order).alias("rank"), key, F.col("w").cast("bigint").alias("weight"))


def last_writers(df: DataFrame, cell: dict[str, Column], order: str, value: str) -> DataFrame:
    """(*cell, order, value, n): the last row written to each cell, and how many were."""
    return df.groupBy(*(c.alias(k) for k, c in cell.items())).agg(F.max(order).alias(order), F.max_by(value, order).alias(value), F.count("*").alias("n"))


def edge_mask(df: DataFrame, by: list[str], order: str, value: str, limit: int, blimit: int) -> DataFrame:
    """Adds ``masked``: whether the four samples before and from each row on are smooth; null near a group's ends."""
    w = Window.partitionBy(*by).orderBy(order)
    p = [F.lag(value, i + 1).over(w) for i in range(4)]
    q = [F.lead(value, i).over(w) if i else F.col(value) for i in range(4)]
    smooth = F.abs(p[0] - q[0]) * 2 + F.shiftright(F.abs(p[1] - q[1]), 1) <= blimit
    for side in (p, q):
        for x, y in zip(side, side[1:], strict=False):
            smooth = smooth & (F.abs(x - y) <= limit)
    whole = p[3].isNotNull() & q[3].isNotNull()
    return df.withColumn("masked", F.when(whole, smooth))


def lag_products(df: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """(*by, lag, n, xy): sums of products of a group's samples ``lag`` places apart."""
    w = Window.partitionBy(*by).orderBy(order)
    parts = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(value) * (F.lag(value, k).over(w) if k else F.col(value))).alias("xy")) for k in range(lags)))
    rows = df.select(*by, parts.alias("parts")).select(*by, F.explode("parts").alias("x")).filter("x.xy IS NOT NULL")
    return rows.groupBy(*by, F.col("x.lag").alias("lag")).agg(F.count("*").alias("n"), F.sum("x.xy").alias("xy"))


def strength_bins(df: DataFrame, x: Column, s: Column, low: int, step: int, bins: int) -> DataFrame:
    """(bin, n, m00, m01, m11, b0, b1): normal equations of a piecewise linear fit of s over x, in units of 1/step.

    Row i has what its samples add to the matrix of bins i and i + 1 and to the right side.
    """
    p = F.least(F.greatest(x - low, F.lit(0)), F.lit(step * (bins - 1)))
    i = F.least(div(p, step), F.lit(bins - 2))
    rows = df.select(i.alias("bin"), (p - i * step).alias("a"), s.alias("s"))
    left, right = F.lit(step) - F.col("a"), F.col("a")
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.sum(left * left).alias("m00"),
        F.sum(left * right).alias("m01"),
        F.sum(right * right).alias("m11"),
        F.sum(left * F.col("s")).alias("b0"),
        F.sum(right * F.col("s")).alias("b1"),
    )


def upscaled(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, pos, value): each group's series at twice the rate, the new samples halfway, the last one repeated."""
    after = F.coalesce(F.lead(value).over(Window.partitionBy(by).orderBy(order)), F.col(value))
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    pair = F.array(F.struct((at * 2).alias("pos"), F.col(value).alias("v")), F.struct((at * 2 + 1).alias("pos"), F.shiftright(F.col(value) + after + 1, 1).alias("v")))
    return df.select(by, pair.alias("pair")).select(by, F.explode("pair").alias("x")).select(by, F.col("x.pos").cast("bigint").alias("pos"), F.col("x.v").alias("value"))


def tiles(frames: DataFrame, width: str, height: str, side: int) -> DataFrame:
    """``frames`` once for each tile of ``side`` in it: adds r, c, r0, r1, c0, c1 (ends cut at the frame's)."""
    steps = lambda size: F.sequence(F.lit(0).cast("bigint"), div(F.greatest(F.col(size), F.lit(1)) - 1, side))
    rows = frames.withColumn("r", F.explode(steps(height))).withColumn("c", F.explode(steps(width)))
    bounds = {f"{x}0": F.col(x) * side for x in "rc"} | {f"{x}1": F.least(F.col(x) * side + side, F.col(size)) for x, size in (("r", height), ("c", width))}
    return rows.withColumns(bounds)
