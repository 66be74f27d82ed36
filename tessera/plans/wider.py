"""Queries that widen the catalogue's operators: more sizes, kernels, predictors, distances and networks, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.fixed import clamp
from ..operators import blocks as B
from ..operators import filters as X
from ..operators import grids as G
from ..operators import histograms as H
from ..operators import lookups as L
from ..operators import predict as P
from ..operators import wide as W
from ..sources.tables import load
from .catalogue import CACHE, _blocks, quantity
from .further import GRID
from .more import PAIRS, _pairs, oracle
from .sql import CELLS
from .sql import Q as QUANTITY
from .sql import clamp as sql_clamp
from .sql import matrix, values

# ---- scalars and look-ups ----


@oracle(f"""
  WITH v AS (SELECT CAST(l_quantity AS BIGINT) AS v, l_linenumber * 6 AS ref FROM lineitem),
  f AS (SELECT v, ref, CASE WHEN ref * 2 <= 64 THEN v ELSE 63 - v END AS x, CASE WHEN ref * 2 <= 64 THEN ref ELSE 63 - ref END AS r FROM v)
  SELECT (CASE WHEN x > 2 * r THEN x WHEN x >= r THEN (x - r) * 2 ELSE (r - x) * 2 - 1 END)::BIGINT AS code, count(*) AS n, min(v) AS low, max(v) AS high FROM f GROUP BY 1""")
def recentred_codes(spark, d):
    """Values coded by how far they are from a reference, the nearer first; both turned over in the upper half."""
    rows = load(spark, d, "lineitem").select(quantity().alias("v"), (F.col("l_linenumber") * 6).alias("ref"))
    return rows.groupBy(W.recentred(F.col("v"), F.col("ref"), 64).alias("code")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@oracle(f"""
  WITH h AS (SELECT {QUANTITY} AS value, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT * FROM (VALUES {values(enumerate(CACHE))}) AS t(i, c)),
  x AS (SELECT value, n, arg_min(c, (abs(value - c), i)) AS c FROM h, k GROUP BY value, n)
  SELECT value, n, abs(value - c) <= 2 AS cached, (CASE WHEN abs(value - c) <= 2 THEN c ELSE value END)::BIGINT AS snapped FROM x""")
def snap_within_limit(spark, d):
    hist = H.histogram(load(spark, d, "lineitem"), quantity())
    near = hist.select("value", "n", L.nearest(F.col("value"), CACHE).alias("x")).withColumn("cached", F.col("x.distance") <= 2)
    return near.select("value", "n", "cached", F.when(F.col("cached"), F.col("x.value")).otherwise(F.col("value")).alias("snapped"))


@oracle(f"""
  WITH {CELLS}, k AS (SELECT vec_id AS l, i, v AS w FROM cells WHERE vec_id % 7 = 0), d AS (SELECT vec_id, l, sum((v - w) * (v - w))::BIGINT AS d FROM cells JOIN k USING (i) WHERE vec_id % 7 <> 0 GROUP BY ALL)
  SELECT vec_id, arg_min(l, (d, l)) AS centroid, min(d) AS distance FROM d GROUP BY 1""")
def nearest_of_many(spark, d):
    b = _blocks(spark, d)
    return L.nearest_block_of_many(b.filter("vec_id % 7 <> 0"), b.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("label"), "b"))


@oracle(f"""
  WITH {CELLS}, v AS (SELECT vec_id, label, (sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT AS v FROM cells GROUP BY ALL)
  SELECT label, floor(log2(v + 1.5e0) * 4)::BIGINT AS log_variance, count(*) AS n FROM v GROUP BY ALL""")
def log_variance_bins(spark, d):
    node = _blocks(spark, d).select("label", B.node_sums(F.col("b"), 8)[0].alias("x"))
    v = F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6)
    return node.groupBy("label", F.floor(F.log2(v + F.lit(1.5)) * 4).alias("log_variance")).agg(F.count("*").alias("n"))


@oracle(f"""
  WITH {GRID}, {CELLS}, e AS (SELECT vec_id, list(v ORDER BY cells.r) FILTER (cells.c = 0) AS first_, list(v ORDER BY cells.r) FILTER (cells.c = 7) AS last_ FROM cells GROUP BY 1),
  n AS (SELECT vec_id, first_, lag(last_) OVER (PARTITION BY frame, r ORDER BY c) AS beside FROM g JOIN e USING (vec_id))
  SELECT vec_id, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(first_, beside)])::BIGINT AS step FROM n WHERE beside IS NOT NULL""")
def block_boundaries(spark, d):
    """How far each block's first column is from the last one of the block to its left."""
    column = lambda c: F.array(*(F.col("b")[r * 8 + c] for r in range(8)))
    place = {"frame": F.expr("vec_id div 256"), "r": F.expr("vec_id div 16 % 16"), "c": F.expr("vec_id % 16"), "first": column(0), "last": column(7)}
    rows = G.with_neighbours(_blocks(spark, d).withColumns(place), "frame", "r", "c", ["last"]).filter("last_left IS NOT NULL")
    return rows.select("vec_id", B.total(F.zip_with("first", "last_left", lambda x, y: F.abs(x - y))).alias("step"))


# ---- distances ----


@oracle(f"""
  WITH {PAIRS}, o AS (SELECT p.vec_id, a.r, a.c, a.v, b.v AS x, c.v AS y FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i
    JOIN cells c ON c.vec_id = other_id AND c.r = a.r AND c.c = least(a.c + 1, 7))
  SELECT vec_id, sum(abs(v - ((8 * (c + 1) * x + (64 - 8 * (c + 1)) * y + 32) >> 6)))::BIGINT AS masked, sum(abs(v - ((x + y + 1) >> 1)))::BIGINT AS averaged,
    (sum((v - ((x + y + 1) >> 1)) * (v - ((x + y + 1) >> 1))) - ((sum(v - ((x + y + 1) >> 1))::BIGINT * sum(v - ((x + y + 1) >> 1))::BIGINT) >> 6))::BIGINT AS half_variance FROM o GROUP BY 1""")
def masked_and_averaged_sad(spark, d):
    """A block against another one and that one moved by a column: mixed by a mask, averaged, and halfway between."""
    pairs = _pairs(spark, d).withColumn("beside", B.shifted("other", 0, 1, True))
    mask = F.array(*(F.lit(8 * (c + 1)) for _ in range(8) for c in range(8)))
    mixed = F.zip_with(F.zip_with("other", mask, lambda x, m: x * m), F.zip_with("beside", mask, lambda y, m: y * (F.lit(64) - m)), lambda x, y: F.shiftright(x + y + 32, 6))
    half = F.zip_with("other", "beside", lambda x, y: F.shiftright(x + y + 1, 1))
    pairs = pairs.select("vec_id", F.zip_with("b", mixed, lambda x, y: x - y).alias("m"), F.zip_with("b", half, lambda x, y: x - y).alias("h"))
    size = lambda x: B.total(F.transform(x, F.abs))
    variance = B.total(F.transform("h", lambda x: x * x)) - F.shiftright(B.total(F.col("h")) * B.total(F.col("h")), 6)
    return pairs.select("vec_id", size("m").alias("masked"), size("h").alias("averaged"), variance.alias("half_variance"))


@oracle(f"""
  WITH {CELLS}, q AS (SELECT vec_id, r // 4 * 2 + c // 4 AS q, r % 4 AS r, c % 4 AS c, v FROM cells), m AS (SELECT * FROM (VALUES {matrix([row[:4] for row in B.HADAMARD[:4]])}) AS t(k, j, w)),
  h AS (SELECT vec_id, q, r, k, sum(v * w) AS x FROM q JOIN m ON c = j GROUP BY ALL), t AS (SELECT vec_id, q, m.k AS kr, h.k AS kc, sum(x * w) AS x FROM h JOIN m ON r = j GROUP BY ALL),
  s AS (SELECT vec_id, q, sum(abs(x))::BIGINT >> 1 AS satd FROM t GROUP BY ALL) SELECT vec_id, sum(satd)::BIGINT AS satd, max(satd) AS most FROM s GROUP BY 1""")
def hadamard_4x4(spark, d):
    small = [row[:4] for row in B.HADAMARD[:4]]
    sizes = F.transform(X.quarters(F.col("b")), lambda q: F.shiftright(B.total(F.transform(W.both_sides(q, 4, small, small, "bigint"), F.abs)), 1))
    return _blocks(spark, d).select("vec_id", sizes.alias("s")).select("vec_id", B.total(F.col("s")).alias("satd"), F.array_max("s").alias("most"))


# ---- transforms ----

SINE = [[math.sqrt(2 / 8) * math.sin((2 * i + 1) * (2 * k + 1) * math.pi / 32) for i in range(8)] for k in range(8)]
IDENTITY = [[1.0 if i == k else 0.0 for i in range(8)] for k in range(8)]
KERNELS = {"cosine": B.DCT, "sine": SINE, "identity": IDENTITY}
#: Pairs of kernels that are tried, down and across.
TYPES = [("cosine", "cosine"), ("sine", "cosine"), ("cosine", "sine"), ("sine", "sine"), ("identity", "identity"), ("identity", "cosine"), ("cosine", "identity")]


@oracle(f"""
  WITH {CELLS}, m AS ({' UNION ALL '.join(f"SELECT '{name}' AS kernel, k, j, w::DOUBLE AS w FROM (VALUES {matrix(m)}) AS t(k, j, w)" for name, m in KERNELS.items())}),
  h AS (SELECT vec_id, kernel AS across, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL),
  t AS (SELECT vec_id, m.kernel AS down, across, m.k AS kr, h.k AS kc, sum(x * w) AS x FROM h JOIN m ON r = j GROUP BY ALL),
  y AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TYPES))}) AS t(type, down, across)),
  e AS (SELECT vec_id, type, count(*) FILTER (abs(x) >= 90.123e0) AS n_large FROM t JOIN y USING (down, across) GROUP BY ALL)
  SELECT vec_id, arg_min(type, (n_large, type))::INTEGER AS type, min(n_large) AS n_large FROM e GROUP BY 1""")
def transform_type_argmin(spark, d):
    """The pair of kernels that leaves the fewest large coefficients."""
    rows = _blocks(spark, d).withColumn("x", F.transform("b", lambda v: v.cast("double")))
    large = lambda a, b: F.size(F.filter(W.both_sides(F.col("x"), 8, KERNELS[a], KERNELS[b], "double"), lambda v: F.abs(v) >= 90.123)).cast("bigint")
    best = F.array_min(F.array(*(F.struct(large(a, b).alias("n_large"), F.lit(i).alias("type")) for i, (a, b) in enumerate(TYPES))))
    return rows.select("vec_id", best.alias("y")).select("vec_id", "y.type", "y.n_large")


WAVES = {name: [[f(2 * math.pi * i * k / 8) for i in range(8)] for k in range(8)] for name, f in (("re", math.cos), ("im", math.sin))}


@oracle(f"""
  WITH {CELLS}, f AS (SELECT vec_id, label, r, k AS kc, sum(v * cos(2 * pi() * c * k / 8)) AS re, sum(v * sin(2 * pi() * c * k / 8)) AS im FROM cells, range(8) AS t(k) GROUP BY ALL),
  g AS (SELECT vec_id, label, k AS kr, kc, sum(re * cos(2 * pi() * r * k / 8) - im * sin(2 * pi() * r * k / 8)) AS re, sum(im * cos(2 * pi() * r * k / 8) + re * sin(2 * pi() * r * k / 8)) AS im FROM f, range(8) AS t(k) GROUP BY ALL)
  SELECT label, (kr * 8 + kc)::INTEGER AS freq, round(log2(sum(re * re + im * im) / 64 + 1.5e0), 4) AS power FROM g GROUP BY ALL""")
def power_spectrum(spark, d):
    rows = _blocks(spark, d).withColumn("x", F.transform("b", lambda v: v.cast("double")))
    part = lambda a, b: W.both_sides(F.col("x"), 8, WAVES[a], WAVES[b], "double")
    re = F.zip_with(part("re", "re"), part("im", "im"), lambda x, y: x - y)
    im = F.zip_with(part("re", "im"), part("im", "re"), lambda x, y: x + y)
    power = F.zip_with(re, im, lambda x, y: x * x + y * y)
    rows = rows.select("label", F.posexplode(power).alias("freq", "p"))
    return rows.groupBy("label", "freq").agg(F.round(F.log2(F.sum("p") / 64 + 1.5), 4).alias("power"))


# ---- statistics ----


@oracle(f"""
  WITH {PAIRS}, k AS (SELECT row_number() OVER (ORDER BY dr, dc) - 1 AS k, dr, dc FROM range(-1, 2) AS a(dr), range(-1, 2) AS b(dc)),
  x AS (SELECT p.vec_id, a.label, a.i, k, b.v AS x, y.v AS y FROM p JOIN cells a ON a.vec_id = p.vec_id AND a.r BETWEEN 1 AND 6 AND a.c BETWEEN 1 AND 6, k, cells b, cells y
    WHERE b.vec_id = p.vec_id AND b.r = a.r + dr AND b.c = a.c + dc AND y.vec_id = other_id AND y.i = a.i)
  SELECT a.label, a.k::INTEGER AS k, b.k::INTEGER AS l, sum(a.x * b.x)::BIGINT AS h, sum(CASE WHEN a.k = b.k THEN a.x * a.y END)::BIGINT AS m FROM x a JOIN x b USING (vec_id, i) WHERE a.k <= b.k GROUP BY ALL""")
def window_statistics(spark, d):
    """Sums of products of a 3 x 3 window's cells with each other, and with the cell that they are to predict."""
    inner = F.array(*map(F.lit, B.INTERIOR))
    at = lambda b, dr, dc: F.transform(inner, lambda i: F.get(b, i + dr * 8 + dc))
    moves = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    pairs = _pairs(spark, d).select("label", *(at("b", *m).alias(f"x{k}") for k, m in enumerate(moves)), at("other", 0, 0).alias("y"))
    product = lambda a, b: F.sum(B.total(F.zip_with(a, b, lambda x, y: x * y)))
    sums = pairs.groupBy("label").agg(*(product(f"x{k}", f"x{l}").alias(f"h{k}{l}") for k in range(9) for l in range(k, 9)), *(product(f"x{k}", "y").alias(f"m{k}") for k in range(9)))  # noqa: E741
    null = F.lit(None).cast("bigint")
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(l).alias("l"), F.col(f"h{k}{l}").alias("h"), (F.col(f"m{k}") if k == l else null).alias("m")) for k in range(9) for l in range(k, 9)))  # noqa: E741
    return sums.select("label", F.explode(rows).alias("z")).select("label", "z.k", "z.l", "z.h", "z.m")


def _box_sql(reach: int) -> str:
    n = (2 * reach + 1) ** 2
    return f"(SELECT sum(b.v) FROM cells b WHERE b.vec_id = a.vec_id AND b.r BETWEEN a.r - {reach} AND a.r + {reach} AND b.c BETWEEN a.c - {reach} AND a.c + {reach})::BIGINT - {n} * a.v"


@oracle(f"""
  WITH {PAIRS}, f AS (SELECT p.vec_id, a.label, {_box_sql(1)} AS f, {_box_sql(2)} AS g, y.v - a.v AS e FROM p JOIN cells a ON a.vec_id = p.vec_id AND a.r BETWEEN 2 AND 5 AND a.c BETWEEN 2 AND 5 JOIN cells y ON y.vec_id = other_id AND y.i = a.i),
  s AS (SELECT label, sum(f * f)::DOUBLE AS ff, sum(f * g)::DOUBLE AS fg, sum(g * g)::DOUBLE AS gg, sum(f * e)::DOUBLE AS fe, sum(g * e)::DOUBLE AS ge FROM f GROUP BY 1)
  SELECT label, round((fe * gg - ge * fg) / (ff * gg - fg * fg), 7) + 0.0 AS x0, round((ge * ff - fe * fg) / (ff * gg - fg * fg), 7) + 0.0 AS x1 FROM s""")
def self_guided_projection(spark, d):
    """The two box filters' shares that bring a block nearest to another one: their normal equations, solved."""
    pairs = _pairs(spark, d).withColumn("given", F.col("b"))
    boxes = {k: B.box_sums(pairs, reach).select("vec_id", "label", "given", "other", F.col("b").alias(k)) for k, reach in (("f", 1),)}
    both = B.box_sums(boxes["f"].withColumn("b", F.col("given")), 2).withColumnRenamed("b", "g")
    inner = F.array(*(F.lit(r * 8 + c) for r in range(2, 6) for c in range(2, 6)))
    cut = lambda x: F.transform(inner, lambda i: F.get(x, i))
    less = lambda box, n: F.zip_with(cut(box), cut("given"), lambda s, x: s - x * n)
    rows = both.select("label", less("f", 9).alias("f"), less("g", 25).alias("g"), F.zip_with(cut("other"), cut("given"), lambda y, x: y - x).alias("e"))
    product = lambda a, b: F.sum(B.total(F.zip_with(a, b, lambda x, y: x * y))).cast("double")
    s = rows.groupBy("label").agg(*(product(a, b).alias(a + b) for a, b in ("ff", "fg", "gg", "fe", "ge")))
    det = F.expr("ff * gg - fg * fg")
    return s.select("label", (F.round(F.expr("fe * gg - ge * fg") / det, 7) + 0.0).alias("x0"), (F.round(F.expr("ge * ff - fe * fg") / det, 7) + 0.0).alias("x1"))


# ---- predictions ----

#: Weights of the nearer edge, by distance from it, of 256.
SMOOTH = [255, 197, 146, 105, 73, 50, 37, 32]


@oracle(f"""
  WITH {PAIRS}, w AS (SELECT * FROM (VALUES {values(enumerate(SMOOTH))}) AS t(i, w)), t AS (SELECT vec_id, c, v AS above FROM cells WHERE r = 0), l AS (SELECT vec_id, r, v AS beside FROM cells WHERE c = 0),
  x AS (SELECT p.vec_id, a.v, (wr.w * above + (256 - wr.w) * lb.v + wc.w * beside + (256 - wc.w) * ra.v + 256) >> 9 AS both_, (wr.w * above + (256 - wr.w) * lb.v + 128) >> 8 AS down
    FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN t ON t.vec_id = other_id AND t.c = a.c JOIN l ON l.vec_id = other_id AND l.r = a.r JOIN w wr ON wr.i = a.r JOIN w wc ON wc.i = a.c
      JOIN cells lb ON lb.vec_id = other_id AND lb.i = 56 JOIN cells ra ON ra.vec_id = other_id AND ra.i = 7)
  SELECT vec_id, sum((v - both_) * (v - both_))::BIGINT AS both_sse, sum((v - down) * (v - down))::BIGINT AS down_sse FROM x GROUP BY 1""")
def smooth_predictors(spark, d):
    above, beside = [F.col("other")[c] for c in range(8)], [F.col("other")[r * 8] for r in range(8)]
    down = lambda r, c: above[c] * SMOOTH[r] + beside[7] * (256 - SMOOTH[r])
    across = lambda r, c: beside[r] * SMOOTH[c] + above[7] * (256 - SMOOTH[c])
    places = [(r, c) for r in range(8) for c in range(8)]
    both = F.array(*(F.shiftright(down(r, c) + across(r, c) + 256, 9) for r, c in places))
    one = F.array(*(F.shiftright(down(r, c) + 128, 8) for r, c in places))
    return _pairs(spark, d).select("vec_id", P.squared_error(F.col("b"), both).alias("both_sse"), P.squared_error(F.col("b"), one).alias("down_sse"))


@oracle(f"""
  WITH {PAIRS}, x AS (SELECT p.vec_id, k, (a.v - b.v) * (a.v - b.v) AS e FROM p, range(-3, 4) AS t(k), cells a, cells b
    WHERE a.vec_id = p.vec_id AND b.vec_id = other_id AND b.r = {sql_clamp('a.r + (((a.c - 4) * k) >> 3)', 0, 7)} AND b.c = {sql_clamp('a.c + (((a.r - 4) * k) >> 3)', 0, 7)}),
  s AS (SELECT vec_id, k, sum(e)::BIGINT AS sse FROM x GROUP BY ALL) SELECT vec_id, min(sse) AS sse, arg_min(k, (sse, k))::INTEGER AS k FROM s GROUP BY 1""")
def warped_argmin(spark, d):
    """The shear by which another block, its edges repeated, is most like this one."""
    near = lambda x: min(max(x, 0), 7)
    places = {k: F.array(*(F.lit(near(r + ((c - 4) * k >> 3)) * 8 + near(c + ((r - 4) * k >> 3))) for r in range(8) for c in range(8))) for k in range(-3, 4)}
    sse = lambda k: P.squared_error(F.col("b"), F.transform(places[k], lambda i: F.get("other", i)))
    best = F.array_min(F.array(*(F.struct(sse(k).alias("sse"), F.lit(k).alias("k")) for k in places)))
    return _pairs(spark, d).select("vec_id", best.alias("x")).select("vec_id", "x.sse", "x.k")


GRAIN_POINTS = [(0, 20), (128, 60), (255, 96)]


@oracle(f"""
  WITH {CELLS}, s AS (SELECT *, CASE WHEN abs(v) < 128 THEN 20 + ((abs(v) * ({40 * ((65536 + 64) // 128)}) + 32768) >> 16) WHEN abs(v) < 255 THEN 60 + (((abs(v) - 128) * ({36 * ((65536 + 63) // 127)}) + 32768) >> 16) ELSE 96 END AS scale,
    (i * 37 + vec_id * 91) % 61 - 30 AS grain FROM cells)
  SELECT vec_id, sum(abs((scale * grain + 32) >> 6))::BIGINT AS noise, sum({sql_clamp('v + ((scale * grain + 32) >> 6)', -256, 255)})::BIGINT AS total FROM s GROUP BY 1""")
def grain_applied(spark, d):
    """Noise from a rule, scaled by each cell's size along a piecewise line, added and clipped."""
    scale = F.transform("b", lambda x: L.piecewise(F.abs(x), GRAIN_POINTS))
    noise = F.zip_with(scale, F.transform("b", lambda _, i: (i * 37 + F.col("vec_id") * 91) % 61 - 30), lambda s, g: F.shiftright(s * g + 32, 6))
    rows = _blocks(spark, d).withColumn("n", noise)
    total = B.total(F.zip_with("b", "n", lambda x, n: clamp(x + n, -256, 255)))
    return rows.select("vec_id", B.total(F.transform("n", F.abs)).alias("noise"), total.alias("total"))


# ---- networks and contexts ----

CONVOLUTION = [[(k * 5 + dr * 3 + dc * 7) % 5 - 2 for dr in range(3) for dc in range(3)] for k in range(3)]
HEAD = [[(k * 11 + n * 5) % 9 - 4 for n in range(4)] for k in range(3)]


@oracle(f"""
  WITH {CELLS}, w AS (SELECT k, dr - 1 AS dr, dc - 1 AS dc, (k * 5 + dr * 3 + dc * 7) % 5 - 2 AS w FROM range(3) AS a(k), range(3) AS b(dr), range(3) AS c(dc)),
  f AS (SELECT a.vec_id, a.label, k, a.r, a.c, greatest(sum(b.v * w), 0)::BIGINT AS x FROM cells a, w, cells b WHERE b.vec_id = a.vec_id AND b.r = {sql_clamp('a.r + dr', 0, 7)} AND b.c = {sql_clamp('a.c + dc', 0, 7)} GROUP BY ALL),
  p AS (SELECT vec_id, label, k, r // 4 * 2 + c // 4 AS n, sum(x)::BIGINT >> 4 AS x FROM f GROUP BY ALL),
  s AS (SELECT vec_id, label, sum(x * ((k * 11 + n * 5) % 9 - 4))::BIGINT AS score FROM p GROUP BY ALL)
  SELECT label, count(*) AS n, count(*) FILTER (score < 0) AS n_pruned, sum(score)::BIGINT AS score FROM s GROUP BY 1""")
def network_prune(spark, d):
    """A 3 x 3 convolution, rectified and pooled, and a dense head: blocks with a score below 0 are not tried."""
    rows = W.scored_by_network(_blocks(spark, d), CONVOLUTION, HEAD)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0).alias("n_pruned"), F.sum("score").alias("score"))


@oracle(f"""
  WITH {CELLS}, k AS (SELECT vec_id, label, r, c, (((v >> 6) % 3) + 3) % 3 AS k FROM cells),
  v AS (SELECT a.vec_id, a.label, a.r, a.c, n.k AS colour, sum(CASE WHEN n.r < a.r AND n.c < a.c THEN 1 ELSE 2 END) AS s
    FROM k a JOIN k n ON n.vec_id = a.vec_id AND ((n.r = a.r AND n.c = a.c - 1) OR (n.r = a.r - 1 AND n.c = a.c) OR (n.r = a.r - 1 AND n.c = a.c - 1)) WHERE a.r > 0 AND a.c > 0 GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, r, c ORDER BY s DESC, colour) AS place FROM v),
  x AS (SELECT vec_id, label, r, c, sum(CASE place WHEN 1 THEN s ELSE 2 * s END)::INTEGER AS context, max(CASE WHEN o.colour = k.k THEN place ELSE 4 END) FILTER (o.colour = k.k) AS place FROM o JOIN k USING (vec_id, label, r, c) GROUP BY ALL)
  SELECT label, context, coalesce(place, 4)::INTEGER AS place, count(*) AS n FROM x GROUP BY ALL""")
def palette_order_contexts(spark, d):
    """Of each inner cell: its neighbours' colours in order of their votes, the votes' weighted sum, and the own colour's place."""
    rows = _blocks(spark, d).select("label", F.transform("b", lambda x: F.pmod(F.shiftright(x, 6), F.lit(3))).alias("k"))
    return W.colour_contexts(rows, "label", "k", 3).groupBy("label", "context", "place").agg(F.count("*").alias("n"))


@oracle("""
  WITH s AS (SELECT o_orderkey, o_custkey % 40 AS x, o_orderkey % 2 = 0 AS dc FROM orders), t AS (SELECT o_orderkey, dc, CASE WHEN dc THEN 4 + x + ((x * x) >> 5) ELSE 4 + x + ((x * x) >> 4) END AS step FROM s)
  SELECT dc, step, count(*) AS n, max(least(step * 3, 200))::BIGINT AS scaled FROM t GROUP BY ALL""")
def plane_steps(spark, d):
    """Steps of two planes from one index, by two tables: a join with both under a flag."""
    x = F.col("id")
    tables = spark.range(40).select(x.alias("x"), F.explode(F.array(F.struct(F.lit(True).alias("dc"), (x + 4 + F.shiftright(x * x, 5)).alias("step")), F.struct(F.lit(False).alias("dc"), (x + 4 + F.shiftright(x * x, 4)).alias("step")))).alias("s")).select("x", "s.*")
    counts = load(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("x"), (F.col("o_orderkey") % 2 == 0).alias("dc")).agg(F.count("*").alias("n"))
    joined = counts.join(F.broadcast(tables), ["x", "dc"])
    return joined.groupBy("dc", "step").agg(F.sum("n").alias("n"), F.max(F.least(F.col("step") * 3, F.lit(200))).alias("scaled"))
