"""More queries of the catalogue, each with its SQL: prediction, scalars, folds, sets, text tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import clamp, div
from ..operators import blocks as B
from ..operators import predict as P
from ..operators import sequences as S
from ..sources import grain
from ..sources.tables import blocks, load
from ..streaming.slots import hourly_totals
from .catalogue import _blocks, _events, quantity, query
from .sql import CELLS, EVENTS, ORACLES, matrix
from .sql import Q as QUANTITY
from .sql import clamp as sql_clamp

PAIRS = f"{CELLS}, p AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) AS other_id FROM embeddings)"


def oracle(sql: str):
    def add(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return add


def _pairs(spark, d):
    return B.neighbours(blocks(load(spark, d, "embeddings")), 64)


@oracle(f"""
  WITH s AS (SELECT q, 4 + q + ((q * q) >> 7) AS step FROM range(256) AS t(q))
  SELECT step, count(*) AS n FROM (SELECT {sql_clamp('p_size * 5 + p_partkey % 7 - 3', 0, 255)} AS q FROM part) JOIN s USING (q) GROUP BY 1""")
def quant_step_lookup(spark, d):
    steps = spark.range(256).select(F.col("id").alias("q"), (4 + F.col("id") + F.shiftright(F.col("id") * F.col("id"), 7)).alias("step"))
    q = clamp(F.col("p_size") * 5 + F.col("p_partkey") % 7 - 3, 0, 255)
    counts = load(spark, d, "part").groupBy(q.alias("q")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(steps), "q").groupBy("step").agg(F.sum("n").alias("n"))


@oracle("SELECT (x & 63) - (x & 64) AS distance, count(*) AS n FROM (SELECT (o_custkey % 128 - o_orderkey % 128) & 127 AS x FROM orders) GROUP BY 1")
def order_hint_distance(spark, d):
    x = (F.col("o_custkey") % 128 - F.col("o_orderkey") % 128).bitwiseAND(127)
    return load(spark, d, "orders").groupBy((x.bitwiseAND(63) - x.bitwiseAND(64)).alias("distance")).agg(F.count("*").alias("n"))


@oracle(f"SELECT CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS folded, count(*) AS n FROM (SELECT {QUANTITY} - 25 AS v FROM lineitem) GROUP BY 1")
def folded_remap(spark, d):
    v = quantity() - 25
    return load(spark, d, "lineitem").groupBy(F.when(v >= 0, v * 2).otherwise(v * -2 - 1).alias("folded")).agg(F.count("*").alias("n"))


@oracle(f"""
  WITH {EVENTS}, b AS (SELECT user_id, v, min(v) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
  SELECT user_id, count(*) AS n, count(*) FILTER (best IS NULL OR v < best + (best >> 1)) AS n_kept FROM b GROUP BY 1""")
def running_best_prune(spark, d):
    before = Window.partitionBy("user_id", "day").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _events(spark, d).select("user_id", "v", F.min("v").over(before).alias("best"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.expr("best IS NULL OR v < best + shiftright(best, 1)")).alias("n_kept"))


LAYER = [[(i * 7 + k * 13) % 17 - 8 for i in range(64)] for k in range(4)]


@oracle(f"""
  WITH {CELLS}, o AS (SELECT vec_id, k, greatest(sum(v * ((i * 7 + k * 13) % 17 - 8)), 0)::BIGINT AS x FROM cells, range(4) AS t(k) GROUP BY ALL)
  SELECT vec_id, arg_min(k, (-x, k))::INTEGER AS class, max(x) AS score FROM o GROUP BY 1""")
def dense_layer(spark, d):
    out = P.dense(_blocks(spark, d), LAYER)
    return out.select("vec_id", (F.array_position("out", F.array_max("out")).cast("int") - 1).alias("class"), F.array_max("out").alias("score"))


@oracle(f"""
  WITH {CELLS}, k AS (SELECT vec_id, label, r, c, (((v >> 7) % 4) + 4) % 4 AS k FROM cells),
  v AS (SELECT a.vec_id, a.label, a.r, a.c, n.k AS colour, sum(CASE WHEN n.r < a.r AND n.c < a.c THEN 1 ELSE 2 END) AS s
    FROM k a JOIN k n ON n.vec_id = a.vec_id AND ((n.r = a.r AND n.c = a.c - 1) OR (n.r = a.r - 1 AND n.c = a.c) OR (n.r = a.r - 1 AND n.c = a.c - 1)) GROUP BY ALL),
  t AS (SELECT vec_id, label, r, c, max(s) AS s FROM v GROUP BY ALL)
  SELECT k.label, coalesce(s, 0)::INTEGER AS score, count(*) AS n FROM k LEFT JOIN t USING (vec_id, r, c) GROUP BY ALL""")
def palette_votes(spark, d):
    return P.cell_votes(_blocks(spark, d), 4)


@oracle(f"""
  WITH {CELLS}, s AS (SELECT vec_id, r // 2 AS r, c // 2 AS c, sum(v)::BIGINT AS s FROM cells GROUP BY ALL),
  m AS (SELECT vec_id, (sum(s)::BIGINT + 8) >> 4 AS mean FROM s GROUP BY 1)
  SELECT vec_id, mean, max(abs(s - mean)) AS most FROM s JOIN m USING (vec_id) GROUP BY ALL""")
def luma_mean_removed(spark, d):
    return P.luma_residual(_blocks(spark, d)).select("vec_id", "mean", F.array_max(F.transform("ac", F.abs)).alias("most"))


@oracle(f"""
  WITH {CELLS}, t AS (SELECT vec_id, c, v AS above FROM cells WHERE r = 0), l AS (SELECT vec_id, r, v AS lft FROM cells WHERE c = 0),
  k AS (SELECT vec_id, v AS corner FROM cells WHERE i = 0),
  m AS (SELECT vec_id, (sum(v) FILTER (r = 0 OR c = 0) - sum(v) FILTER (i = 0))::BIGINT // 14 AS mean FROM cells GROUP BY 1),
  x AS (SELECT vec_id, v, above, lft, mean, corner, abs(above - corner) AS dl, abs(lft - corner) AS da, abs(lft + above - 2 * corner) AS dc
    FROM cells JOIN t USING (vec_id, c) JOIN l USING (vec_id, r) JOIN k USING (vec_id) JOIN m USING (vec_id) WHERE r > 0 AND c > 0),
  p AS (SELECT *, CASE WHEN dl <= da AND dl <= dc THEN lft WHEN da <= dc THEN above ELSE corner END AS paeth FROM x),
  e AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS mode, unnest([sum((v - mean) * (v - mean)), sum((v - above) * (v - above)), sum((v - lft) * (v - lft)), sum((v - paeth) * (v - paeth))])::BIGINT AS sse FROM p GROUP BY 1)
  SELECT vec_id, arg_min(mode, (sse, mode))::INTEGER AS mode, min(sse) AS sse FROM e GROUP BY 1""")
def predictor_argmin(spark, d):
    return P.best_predictor(_blocks(spark, d))


MASK = [min(64, 8 * (c + 1)) for r in range(8) for c in range(8)]


@oracle(f"""
  WITH {PAIRS} SELECT p.vec_id, p.other_id, sum((least(64, 8 * (a.c + 1)) * a.v + (64 - least(64, 8 * (a.c + 1))) * b.v + 32) >> 6)::BIGINT AS total
  FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i GROUP BY ALL""")
def blend_masked(spark, d):
    return P.blended(_pairs(spark, d), MASK).select("vec_id", "other_id", B.total(F.col("b")).alias("total"))


@oracle(f"""
  WITH {PAIRS}, m AS (SELECT x.v AS dr, y.v AS dc FROM (VALUES (-1), (0), (1)) AS x(v), (VALUES (-1), (0), (1)) AS y(v)),
  s AS (SELECT p.vec_id, dr, dc, sum(abs(a.v - b.v))::BIGINT AS sad FROM p, m, cells a, cells b
    WHERE a.vec_id = p.vec_id AND b.vec_id = other_id AND b.r = {sql_clamp('a.r + dr', 0, 7)} AND b.c = {sql_clamp('a.c + dc', 0, 7)} GROUP BY ALL)
  SELECT vec_id, arg_min(dr, (sad, dr, dc))::INTEGER AS dr, arg_min(dc, (sad, dr, dc))::INTEGER AS dc, min(sad) AS sad FROM s GROUP BY 1""")
def displacement_search(spark, d):
    return P.displacement(_pairs(spark, d), 1)


@oracle(f"""
  WITH {CELLS}, w AS (SELECT vec_id, r, max(v) FILTER (c = 2) AS p1, max(v) FILTER (c = 3) AS p0, max(v) FILTER (c = 4) AS q0, max(v) FILTER (c = 5) AS q1 FROM cells GROUP BY ALL),
  m AS (SELECT vec_id, CASE WHEN abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= 150 THEN {sql_clamp('((q0 - p0) * 3 + (p1 - q1) + 4) >> 3', -20, 20)} END AS x FROM w)
  SELECT vec_id, count(x) AS n, coalesce(sum(abs(x)), 0)::BIGINT AS moved FROM m GROUP BY 1""")
def deblock_edge(spark, d):
    return P.smoothed_edge(_blocks(spark, d), 4, 150, 20)


@oracle(f"""
  WITH {CELLS}, n AS (SELECT vec_id, r // 4 * 2 + c // 4 AS quad, (sum(v)::BIGINT + 8) >> 4 AS mean FROM cells GROUP BY ALL)
  SELECT vec_id, quad::INTEGER AS quad, mean FROM n""")
def mean_4x4(spark, d):
    means = F.transform(B.node_sums(F.col("b"), 4), lambda x: F.struct(x["node"].alias("quad"), F.shiftright(x["s"] + 8, 4).alias("mean")))
    return _blocks(spark, d).select("vec_id", F.explode(means).alias("x")).select("vec_id", "x.quad", "x.mean")


@oracle(f"WITH {CELLS} SELECT label, count(*) AS n FROM (SELECT label, vec_id FROM cells GROUP BY ALL HAVING max(abs(v)) <= 300) GROUP BY 1")
def admitted_blocks(spark, d):
    return _blocks(spark, d).filter(F.forall("b", lambda x: F.abs(x) <= 300)).groupBy("label").agg(F.count("*").alias("n"))


#: Fixed value: a quantiser step that no coefficient of integers is a rational multiple of, so that no level is a tie.
COARSE = 61.803398875


@oracle(f"""
  WITH {CELLS}, m AS (SELECT k, j, w::DOUBLE AS w FROM (VALUES {matrix(B.DCT)}) AS t(k, j, w)),
  h AS (SELECT vec_id, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL),
  t AS (SELECT vec_id, m.k AS kr, h.k AS kc, floor(sum(x * w) / {COARSE}::DOUBLE + 0.5) AS level FROM h JOIN m ON r = j GROUP BY ALL),
  g AS (SELECT vec_id, kr, j AS c, sum(level * {COARSE}::DOUBLE * w) AS x FROM t JOIN m ON kc = k GROUP BY ALL),
  i AS (SELECT vec_id, j AS r, g.c, floor(sum(x * w) + 0.5)::BIGINT AS v FROM g JOIN m ON kr = k GROUP BY ALL),
  n AS (SELECT vec_id, count(*) FILTER (level <> 0) AS n_levels FROM t GROUP BY 1)
  SELECT vec_id, n_levels, sum((i.v - cells.v) * (i.v - cells.v))::BIGINT AS sse, max({sql_clamp('i.v', -255, 255)}) AS most
  FROM i JOIN cells USING (vec_id, r, c) JOIN n USING (vec_id) GROUP BY ALL""")
def inverse_transform(spark, d):
    there = B.transformed(_blocks(spark, d), B.DCT, "double").withColumnRenamed("b", "given")
    levels = there.withColumn("level", F.transform("t", lambda x: F.floor(x / COARSE + 0.5)))
    again = levels.withColumn("b", F.transform("level", lambda x: x.cast("double") * COARSE))
    back = B.transformed(again, [list(x) for x in zip(*B.DCT, strict=True)], "double").withColumn("v", F.transform("t", lambda x: F.floor(x + 0.5)))
    n_levels = F.size(F.filter("level", lambda x: x != 0)).cast("bigint")
    sse = B.total(F.zip_with("v", "given", lambda x, y: (x - y) * (x - y)))
    return back.select("vec_id", n_levels.alias("n_levels"), sse.alias("sse"), F.array_max(F.transform("v", lambda x: clamp(x, -255, 255))).alias("most"))


@oracle(f"""
  WITH {CELLS}, f AS (SELECT vec_id, label, r, k, sum(v * cos(2 * pi() * c * k / 8)) AS re, sum(v * sin(2 * pi() * c * k / 8)) AS im FROM cells, range(5) AS t(k) GROUP BY ALL)
  SELECT label, k::INTEGER AS freq, round(sum(re * re + im * im), 2) AS energy FROM f GROUP BY ALL""")
def dft_energy(spark, d):
    wave = lambda f: F.array(*(F.array(*(F.lit(f(2 * math.pi * c * k / 8)) for c in range(8))) for k in range(5)))
    rows = _blocks(spark, d).select("label", F.explode(F.transform(F.array(*map(F.lit, range(8))), lambda r: F.transform(F.slice("b", r * 8 + 1, 8), lambda x: x.cast("double")))).alias("x"))
    part = lambda f: F.transform(wave(f), lambda w: B.total(F.zip_with("x", w, lambda p, q: p * q), "double"))
    rows = rows.select("label", F.posexplode(F.zip_with(part(math.cos), part(math.sin), lambda re, im: re * re + im * im)).alias("freq", "e"))
    return rows.groupBy("label", "freq").agg(F.round(F.sum("e"), 2).alias("energy"))


@oracle(f"""
  WITH {PAIRS}, s AS (SELECT a.label, sum(a.v * a.v)::BIGINT AS xx, sum(a.v)::BIGINT AS x, count(*) AS n, sum(a.v * b.v)::BIGINT AS xy, sum(b.v)::BIGINT AS y
    FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i GROUP BY 1)
  SELECT label, n, round((n * xy - x * y)::DOUBLE / (n * xx - x * x)::DOUBLE, 6) AS slope, round((y * xx - x * xy)::DOUBLE / (n * xx - x * x)::DOUBLE, 4) AS intercept FROM s""")
def least_squares_2x2(spark, d):
    pairs = _pairs(spark, d)
    sums = {"xx": F.zip_with("b", "b", lambda x, y: x * y), "x": F.col("b"), "xy": F.zip_with("b", "other", lambda x, y: x * y), "y": F.col("other")}
    s = pairs.groupBy("label").agg(F.sum(F.size("b")).alias("n"), *(F.sum(B.total(c)).alias(k) for k, c in sums.items()))
    det = F.expr("cast(n * xx - x * x as double)")
    return s.select("label", "n", F.round(F.expr("cast(n * xy - x * y as double)") / det, 6).alias("slope"), F.round(F.expr("cast(y * xx - x * xy as double)") / det, 4).alias("intercept"))


@oracle(f"""
  WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, day, v % 41 - 20 AS x, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS n FROM e),
  f AS (SELECT DISTINCT user_id, day, 0::BIGINT AS n, 60::BIGINT AS carry FROM s
    UNION ALL SELECT f.user_id, f.day, s.n, {sql_clamp('carry + x', 0, 127)} FROM f JOIN s ON s.user_id = f.user_id AND s.day = f.day AND s.n = f.n + 1)
  SELECT user_id, day, n, carry FROM f WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY user_id, day)""")
def clamped_carry(spark, d):
    return S.clamped_sums(_events(spark, d).withColumn("x", F.col("v") % 41 - 20), ["user_id", "day"], "event_id", "x", 60, 0, 127)


@oracle("""
  WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY ALL), b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY ALL)
  SELECT event_type, user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (event_type, user_id)""")
def counter_difference(spark, d):
    late = F.dayofmonth("ts") > 15
    return load(spark, d, "events").groupBy("event_type", "user_id").agg((F.count_if(late) - F.count_if(~late)).alias("change"))


@oracle("""
  SELECT k::INTEGER AS slot, max(event_id) AS last_event, count(*) AS n FROM events, range(8) AS t(k) WHERE (event_id * 37 % 256) >> k & 1 = 1 GROUP BY 1""")
def slot_refresh(spark, d):
    flags = F.col("event_id") * 37 % 256
    slots = F.array(*(F.when(F.shiftright(flags, k).bitwiseAND(1) == 1, F.lit(k)) for k in range(8)))
    rows = load(spark, d, "events").select("event_id", F.explode(F.array_compact(slots)).alias("slot"))
    return rows.groupBy("slot").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@oracle("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return hourly_totals(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@oracle("""
  WITH p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
  SELECT p_brand AS name, n * 10 AS start, n * 10 + 10 AS "end", p_size > 9 AS apply, (p_partkey % 65536)::INTEGER AS seed, 3::BIGINT AS n_params,
    (p_size + n + 2)::BIGINT AS param_sum, printf('E %d %d %d %d 1' || chr(10) || chr(9) || 'p %d %d' || chr(10) || chr(9) || 'sY 2', n * 10, n * 10 + 10, (p_size > 9)::INT, p_partkey % 65536, p_size, n) AS entry
  FROM p WHERE p_partkey % 11 <> 0""")
def grain_table(spark, d):
    """One text a brand, with an entry a part, some of them broken; read and written again entry by entry."""
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint") - 1
    parts = load(spark, d, "part").select("p_brand", "p_partkey", "p_size", order.alias("n"))
    end = F.when(F.col("p_partkey") % 11 == 0, F.lit("x")).otherwise((F.col("n") * 10 + 10).cast("string"))
    entry = F.concat_ws("\n", F.concat_ws(" ", F.lit("E"), F.col("n") * 10, end, (F.col("p_size") > 9).cast("int"), F.col("p_partkey") % 65536, F.lit(1)), F.concat_ws(" ", F.lit("\tp"), "p_size", "n"), F.lit("\tsY 2"))
    texts = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("n", entry.alias("e"))))["e"].alias("e"))
    files = texts.select(F.col("p_brand").alias("name"), F.concat(F.lit("filmgrn1\n"), F.array_join("e", "\n"), F.lit("\n")).alias("value"))
    entries = grain.parsed(files)
    sums = F.aggregate(F.flatten(F.col("params")["values"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return entries.select("name", "start", "end", "apply", "seed", F.size(F.flatten(F.col("params")["values"])).cast("bigint").alias("n_params"), sums.alias("param_sum"), grain.line_of().alias("entry"))


@oracle("""
  WITH g AS (SELECT o_orderkey, i, (o_orderkey >> (7 * i)) & 127 AS part, o_orderkey >> (7 * (i + 1)) AS rest FROM orders, range(9) AS t(i) WHERE i = 0 OR o_orderkey >> (7 * i) > 0)
  SELECT o_orderkey, string_agg(printf('%02X', CASE WHEN rest > 0 THEN part + 128 ELSE part END), '' ORDER BY i) AS bytes FROM g GROUP BY 1""")
def leb128_bytes(spark, d):
    x = F.col("o_orderkey")
    part = lambda i: F.shiftright(x, 7 * i).bitwiseAND(127)
    groups = [F.when((F.lit(i) == 0) | (F.shiftright(x, 7 * i) > 0), F.lpad(F.hex(part(i) + F.when(F.shiftright(x, 7 * (i + 1)) > 0, 128).otherwise(0)), 2, "0")) for i in range(9)]
    return load(spark, d, "orders").select("o_orderkey", F.concat_ws("", *groups).alias("bytes"))


@oracle("""
  WITH f AS (SELECT p_brand, p_partkey, 300 + p_size * 37 AS w, 200 + p_partkey % 50 * 29 AS h FROM part),
  t AS (SELECT p_brand, w, h, r, c, least(c * 256 + 256, w) - c * 256 AS tw, least(r * 256 + 256, h) - r * 256 AS th
    FROM f, range(16) AS x(c), range(16) AS y(r) WHERE c * 256 < w AND r * 256 < h)
  SELECT p_brand, count(*) AS n, sum(tw * th)::BIGINT AS area, count(*) FILTER (tw < 256 OR th < 256) AS n_cut, max(r * 16 + c)::BIGINT AS last FROM t GROUP BY 1""")
def tile_dimension(spark, d):
    frames = load(spark, d, "part").select("p_brand", (300 + F.col("p_size") * 37).cast("bigint").alias("w"), (200 + F.col("p_partkey") % 50 * 29).alias("h"))
    tiles = S.tiles(frames, "w", "h", 256)
    width, height = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    out = tiles.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(width * height).alias("area"), F.count_if((width < 256) | (height < 256)).alias("n_cut"), F.max(F.col("r") * 16 + F.col("c")).alias("last"))
    return out


@oracle(f"""
  WITH {CELLS}, v AS (SELECT vec_id, label, (sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT AS v FROM cells GROUP BY ALL)
  SELECT label, count(*) AS n, sum(1000000000 // (v + 100000))::BIGINT AS weight FROM v GROUP BY 1""")
def weber_weights(spark, d):
    node = _blocks(spark, d).select("label", B.node_sums(F.col("b"), 8)[0].alias("x"))
    v = node.select("label", (F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6)).alias("v"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.sum(div(F.lit(1_000_000_000).cast("bigint"), F.col("v") + 100_000)).alias("weight"))
