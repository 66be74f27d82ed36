"""Queries over whole planes of blocks, each with its SQL: filters across borders, copies, quad-trees, systems, quantiles.

A vector is a block; 16 x 16 consecutive ones are a plane of 128 x 128 cells, the last plane as far as there are vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import noise as Z
from ..functions.fixed import clamp
from ..operators import copies as C
from ..operators import palettes as A
from ..operators import planes as P
from ..operators import quadtree as Q
from ..operators import quantiles as E
from ..operators import search as X
from ..operators import systems as Y
from ..operators import transforms as T
from ..sources.tables import load
from .catalogue import _blocks
from .more import oracle
from .sql import CELLS

#: Cells along a plane's side.
WIDE = 128
PLANE = f"{CELLS}, plane AS (SELECT vec_id // 256 AS frame, vec_id // 16 % 16 * 8 + r AS y, vec_id % 16 * 8 + c AS x, v FROM cells)"


def _plane(spark, d) -> DataFrame:
    return _blocks(spark, d).select(F.expr("vec_id div 256").alias("frame"), F.expr("vec_id div 16 % 16").alias("r"), (F.col("vec_id") % 16).alias("c"), "b")


def _pixels(spark, d) -> DataFrame:
    """The planes' cells as numbers from 0 to 255."""
    return _plane(spark, d).withColumn("b", F.transform("b", lambda v: clamp(F.shiftright(v, 2) + 128, 0, 255)))


def _cells(blocks: DataFrame) -> DataFrame:
    """(frame, y, x, v): a row for each cell."""
    flat = blocks.select("frame", "r", "c", F.posexplode("b").alias("i", "v"))
    return flat.select("frame", (F.col("r") * 8 + F.expr("i div 8")).alias("y"), (F.col("c") * 8 + F.col("i") % 8).alias("x"), "v")


def around(reach: int, value: str = "v") -> str:
    """SQL: g (frame, y, x, there, v): all places of the planes and some around them, 0 where there is no cell."""
    places = f"range({-reach}, {WIDE + reach})"
    return f"""{PLANE}, g AS MATERIALIZED (SELECT f.frame, y.y, x.x, p.v IS NOT NULL AS there, coalesce({value.replace('v', 'p.v')}, 0) AS v
      FROM (SELECT DISTINCT frame FROM plane) f CROSS JOIN {places} y(y) CROSS JOIN {places} x(x) LEFT JOIN plane p ON p.frame = f.frame AND p.y = y.y AND p.x = x.x)"""


def moved_sum(value: str, taps: list[int], along: str) -> str:
    """SQL: sum of a value at places along y or x, times taps."""
    by, reach = {"x": "y", "y": "x"}[along], len(taps) // 2
    over = f"OVER (PARTITION BY frame, {by} ORDER BY {along})"
    move = lambda k: f"coalesce({'lag' if k < 0 else 'lead'}({value}, {abs(k)}) {over}, 0)"
    return "(" + " + ".join(f"{t} * {move(i - reach)}" for i, t in enumerate(taps) if t) + ")"


BOX = [1] * 5


@oracle(f"""
  WITH {around(2)}, h AS (SELECT *, {moved_sum('v', BOX, 'x')} AS h FROM g), s AS (SELECT *, {moved_sum('h', BOX, 'y')} AS s FROM h)
  SELECT frame, y, x, s::BIGINT AS v FROM s WHERE there""")
def plane_box_sums(spark, d):
    return _cells(P.box_sums(_plane(spark, d), 2))


#: A smooth kernel of 7 taps, of sum 64.
SMOOTH = [1, 6, 15, 20, 15, 6, 1]


@oracle(f"""
  WITH {around(3)}, h AS (SELECT *, ({moved_sum('v', SMOOTH, 'x')} + 32) >> 6 AS h FROM g), s AS (SELECT *, ({moved_sum('h', SMOOTH, 'y')} + 32) >> 6 AS s FROM h)
  SELECT frame, y, x, s::BIGINT AS v FROM s WHERE there""")
def plane_separable(spark, d):
    return _cells(P.separable(_plane(spark, d), SMOOTH, 6))


PIXEL = "least(greatest((v >> 2) + 128, 0), 255)"
NEAR, CORNERS, GUIDE = [1, 1, 1], [1, 0, 1], 56


def _spread(x: str) -> str:
    """SQL: 3 x 3 sums of a value already summed along x in the column ``<x>_h``, with corners counted 3 of 4."""
    return f"(4 * {moved_sum(x + '_h', NEAR, 'y')} - {moved_sum(x + '_k', CORNERS, 'y')})"


@oracle(f"""
  WITH {around(2, PIXEL)}, h AS (SELECT *, {moved_sum('v', NEAR, 'x')} AS s, {moved_sum('v * v', NEAR, 'x')} AS q FROM g),
  b AS (SELECT frame, y, x, there, v, {moved_sum('s', NEAR, 'y')} AS s, {moved_sum('q', NEAR, 'y')} AS q FROM h),
  z AS (SELECT *, least((greatest(9 * q - s * s, 0) * {GUIDE} + (1 << 19)) >> 20, 255) AS z FROM b),
  w AS (SELECT *, CASE WHEN z >= 255 THEN 256 ELSE greatest(1, ((z << 8) + z // 2) // (z + 1)) END AS w FROM z),
  m AS (SELECT *, ((256 - w) * s * {P.NINTH} + 2048) >> 12 AS m FROM w),
  a AS (SELECT *, {moved_sum('w', NEAR, 'x')} AS w_h, {moved_sum('w', CORNERS, 'x')} AS w_k, {moved_sum('m', NEAR, 'x')} AS m_h, {moved_sum('m', CORNERS, 'x')} AS m_k FROM m),
  o AS (SELECT *, ({_spread('w')} * v + {_spread('m')} + 256) >> 9 AS o FROM a)
  SELECT frame, y, x, o::BIGINT AS v FROM o WHERE there""")
def plane_self_guided(spark, d):
    return _cells(P.self_guided(_pixels(spark, d), GUIDE))


LIMIT, EDGE_LIMIT, HIGH = 60, 160, 6


def _edges(given: str, name: str, along: str) -> str:
    """SQL: ``given`` (frame, y, x, v) with the edges at every eighth place along y or x smoothed."""
    by = {"x": "y", "y": "x"}[along]
    over = f"OVER (PARTITION BY frame, {by} ORDER BY {along})"
    p, q = [f"l[{4 - i}]" for i in range(4)], [f"l[{5 + i}]" for i in range(4)]
    line = ", ".join([*(f"lag(v, {i}) {over}" for i in (4, 3, 2, 1)), "v", *(f"lead(v, {i}) {over}" for i in (1, 2, 3))])
    mask = " AND ".join([f"abs({p[0]} - {q[0]}) * 2 + abs({p[1]} - {q[1]}) // 2 <= {EDGE_LIMIT}", *(f"abs({x[i]} - {x[i + 1]}) <= {LIMIT}" for x in (p, q) for i in range(3))])
    flat = " AND ".join(f"abs({x[0]} - {x[i]}) <= 1" for x in (p, q) for i in (1, 2, 3))
    signed = lambda x: f"least(greatest({x}, -128), 127)"
    step = signed(f"CASE WHEN varies THEN {signed(f'{p[1]} - {q[1]}')} ELSE 0 END + 3 * ({q[0]} - {p[0]})")
    down, up, few = f"({signed('step + 3')} >> 3)", f"({signed('step + 4')} >> 3)", f"(CASE WHEN varies THEN 0 ELSE ({signed('step + 4')} >> 3) + 1 >> 1 END)"
    lessened = [p[2], f"{signed(f'{p[1]} - 128 + {few}')} + 128", f"{signed(f'{p[0]} - 128 + {down}')} + 128", f"{signed(f'{q[0]} - 128 - {up}')} + 128", f"{signed(f'{q[1]} - 128 - {few}')} + 128", q[2]]
    smooth = "[(list_sum([l[least(greatest(i + d, 1), 8)] FOR d IN range(-3, 4)])::BIGINT + l[i] + 4) >> 3 FOR i IN range(2, 8)]"
    return f"""{name}_l AS (SELECT frame, y, x, [{line}] AS l FROM {given}), {name}_e AS (SELECT *, abs({p[1]} - {p[0]}) > {HIGH} OR abs({q[1]} - {q[0]}) > {HIGH} AS varies FROM {name}_l WHERE {along} % 8 = 0 AND l[4] IS NOT NULL AND {mask}),
      {name}_s AS (SELECT *, {step} AS step FROM {name}_e), {name}_n AS (SELECT frame, y, x, CASE WHEN {flat} THEN {smooth} ELSE [{', '.join(lessened)}] END AS o FROM {name}_s),
      {name}_u AS (SELECT frame, {by}, {along} - 3 + d AS {along}, o[d + 1] AS v FROM {name}_n, range(6) t(d)),
      {name} AS (SELECT g.frame, g.y, g.x, coalesce(u.v, g.v) AS v FROM {given} g LEFT JOIN {name}_u u ON u.frame = g.frame AND u.y = g.y AND u.x = g.x)"""


@oracle(f"WITH {PLANE}, pixels AS (SELECT frame, y, x, {PIXEL} AS v FROM plane), {_edges('pixels', 'upright', 'x')}, {_edges('upright', 'level', 'y')} SELECT frame, y, x, v::BIGINT AS v FROM level")
def plane_deblocked(spark, d):
    return _cells(P.deblocked(_pixels(spark, d), LIMIT, EDGE_LIMIT, HIGH))


NOISE = 30000.0
COSINES = ", ".join(f"({k}, {i}, {x!r}e0)" for k, row in enumerate(P.cosines(8).tolist()) for i, x in enumerate(row))
SINE = "sin(({0} + 0.5e0) * pi() / 8)"


@oracle(f"""
  WITH {around(4)}, k AS (SELECT * FROM (VALUES {COSINES}) AS t(k, i, c)),
  w AS (SELECT frame, y0, x0, y - y0 AS i, x - x0 AS j, v * {SINE.format('(y - y0)')} * {SINE.format('(x - x0)')} AS v FROM g JOIN range(-4, {WIDE}, 4) a(y0) ON y BETWEEN y0 AND y0 + 7 JOIN range(-4, {WIDE}, 4) b(x0) ON x BETWEEN x0 AND x0 + 7),
  r AS (SELECT frame, y0, x0, w.i, k, sum(v * c) AS v FROM w JOIN k ON k.i = w.j GROUP BY ALL),
  t AS (SELECT frame, y0, x0, k.k AS a, r.k AS b, sum(v * c) AS t FROM r JOIN k ON k.i = r.i GROUP BY ALL),
  s AS (SELECT frame, y0, x0, a, b, CASE WHEN t * t > {NOISE} THEN t * (1 - {NOISE}e0 / (t * t)) ELSE 0 END AS t FROM t),
  u AS (SELECT frame, y0, x0, a, k.i AS j, sum(t * c) AS v FROM s JOIN k ON k.k = s.b GROUP BY ALL),
  o AS (SELECT frame, y0 + k.i AS y, x0 + j AS x, sum(v * c) * {SINE.format('k.i')} * {SINE.format('j')} AS v FROM u JOIN k ON k.k = u.a GROUP BY frame, y0, x0, k.i, j)
  SELECT frame, y, x, round(sum(o.v), 4) + 0.0 AS v FROM o JOIN plane USING (frame, y, x) GROUP BY ALL""")
def plane_overlap_add(spark, d):
    return _cells(P.overlap_add(_plane(spark, d), NOISE)).withColumn("v", F.round("v", 4) + 0.0)


def _row(x: str, along: str) -> str:
    by = {"x": "y", "y": "x"}[along]
    over = f"OVER (PARTITION BY frame, {by} ORDER BY {along})"
    return " || ".join([x, *(f"lead({x}, {i}) {over}" for i in range(1, 4))])


@oracle(f"""
  WITH {PLANE}, b AS (SELECT frame, y, x, (v > 0)::INT::VARCHAR AS v FROM plane), h AS (SELECT *, {_row('v', 'x')} AS h FROM b), s AS (SELECT frame, y, x, {_row('h', 'y')} AS s FROM h),
  k AS (SELECT * FROM s WHERE contains(s, '0') AND contains(s, '1')), f AS (SELECT frame, s, min({{'y': y, 'x': x}}) AS f FROM k GROUP BY ALL)
  SELECT frame, y, x, f.y AS from_y, f.x AS from_x FROM k JOIN f USING (frame, s) WHERE y % 4 = 0 AND x % 4 = 0 AND (f.y, f.x) < (y, x)""")
def plane_copies(spark, d):
    """Aligned squares of 4 x 4 signs that stand at some earlier place of their plane."""
    return C.earlier_copies(_plane(spark, d).withColumn("b", F.transform("b", lambda v: (v > 0).cast("bigint"))), 4)


SIGNAL, LEVELS = 45_000, 4


def _quad_levels() -> str:
    steps = [f"{CELLS}, l0 AS (SELECT vec_id // 256 AS frame, vec_id // 16 % 16 AS r, vec_id % 16 AS c, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS ss, (sum(v * v) - sum(v)::BIGINT * sum(v)::BIGINT // 64)::BIGINT AS cost, false AS split FROM cells GROUP BY ALL)"]
    for k in range(1, LEVELS + 1):
        steps.append(f"""u{k} AS (SELECT frame, r >> 1 AS r, c >> 1 AS c, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(ss)::BIGINT AS ss, sum(cost)::BIGINT + {SIGNAL} AS parts FROM l{k - 1} GROUP BY ALL),
          l{k} AS (SELECT frame, r, c, n, s, ss, CASE WHEN n < {(8 << k) ** 2} OR parts < ss - s * s // n THEN parts ELSE ss - s * s // n END AS cost, n < {(8 << k) ** 2} OR parts < ss - s * s // n AS split FROM u{k})""")
    steps.append(f"t{LEVELS} AS (SELECT * FROM l{LEVELS})")
    steps += [f"t{k} AS (SELECT l{k}.* FROM l{k} SEMI JOIN (SELECT * FROM t{k + 1} WHERE split) p ON p.frame = l{k}.frame AND p.r = l{k}.r >> 1 AND p.c = l{k}.c >> 1)" for k in range(LEVELS - 1, -1, -1)]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT frame, {k}::INTEGER AS level, r, c, n, cost FROM t{k} WHERE NOT split" for k in range(LEVELS + 1))


@oracle(_quad_levels())
def plane_partition(spark, d):
    return Q.best_partition(_plane(spark, d), LEVELS, SIGNAL)


# ---- systems ----


def eliminated(m: str, n: int) -> str:
    """SQL: e: rows of ``m`` (by, m: n rows of n + 1) after Gauss-Jordan elimination; the last column is the solution."""
    return f"""e AS (SELECT *, 1 AS k FROM {m} UNION ALL SELECT * EXCLUDE (k) REPLACE (
      [CASE WHEN i = k THEN [x / m[k][k] FOR x IN m[k]] ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] FOR j IN range(1, {n + 2})] END FOR i IN range(1, {n + 1})] AS m), k + 1 AS k FROM e WHERE k <= {n})"""


LAG = 3
OFFSETS = Y.causal_offsets(LAG)
_ACROSS = ", ".join(f"{'lag' if dx < 0 else 'lead'}(v, {abs(dx)}) OVER (PARTITION BY frame, y ORDER BY x) AS h{dx + LAG}" for dx in range(-LAG, LAG + 1))
_DOWN = ", ".join(f"lag(h{dx + LAG}, {-dy}) OVER (PARTITION BY frame, x ORDER BY y)" for dy, dx in [*OFFSETS, (0, 0)])


@oracle(f"""
  WITH RECURSIVE {PLANE}, h AS (SELECT frame, y, x, {_ACROSS} FROM plane), l AS (SELECT frame, [{_DOWN}] AS l FROM h), z AS (SELECT * FROM l WHERE len([v FOR v IN l IF v IS NULL]) = 0),
  p AS (SELECT frame, i, j, sum(l[i] * l[j])::DOUBLE AS s FROM z, range(1, {len(OFFSETS) + 1}) a(i), range(1, {len(OFFSETS) + 2}) b(j) GROUP BY ALL),
  m AS (SELECT frame, list(r ORDER BY i) AS m FROM (SELECT frame, i, list(s ORDER BY j) AS r FROM p GROUP BY ALL) GROUP BY ALL), {eliminated('m', len(OFFSETS))},
  c AS (SELECT frame, count(*) AS n FROM z GROUP BY ALL)
  SELECT frame, n, i::INTEGER AS i, round(m[i + 1][{len(OFFSETS) + 1}], 7) + 0.0 AS x FROM e JOIN c USING (frame), range({len(OFFSETS)}) t(i) WHERE k = {len(OFFSETS) + 1}""")
def plane_autoregression(spark, d):
    """The 24 coefficients that predict a cell of a plane from those within 3 before it."""
    systems = Y.autoregression(_plane(spark, d), LAG)
    fits = Y.solved(systems, ["frame", "n"])
    return fits.select("frame", "n", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 7) + 0.0)


BLUR, FIT_ROUNDS = [1, 6, 1], 3


def _folded(value: str, along: str) -> str:
    """SQL: z0, z1, z2: a value and the sums of those one and two places away along y or x."""
    return ", ".join(f"{moved_sum(value, [int(abs(i - 2) == p) for i in range(5)], along)} AS z{p}" for p in range(3))


def _weighted(taps: str, along: str) -> str:
    """SQL: the symmetric filter of a list of taps (middle, one away, two away) on v."""
    return " + ".join(f"{taps}[{p + 1}] * {moved_sum('v', [int(abs(i - 2) == p) for i in range(5)], along)}" for p in range(3))


def _fit_step(name: str, given: str, along: str, across: str) -> str:
    """SQL: taps along one direction, by the 3 x 3 system of the plane filtered across with the ``given`` taps (frame, t)."""
    pairs = ", ".join(f"[{', '.join(f'sum(z{p} * z{q})::DOUBLE' for q in range(3))}, sum(z{p} * y_)::DOUBLE]" for p in range(3))
    return f"""{name}_f AS (SELECT x.*, ({_weighted('t', across)})::DOUBLE AS f FROM x JOIN {given} USING (frame)), {name}_z AS (SELECT frame, y_, whole, {_folded('f', along)} FROM {name}_f),
      {name}_m AS (SELECT frame, [{pairs}] AS m0 FROM {name}_z WHERE whole GROUP BY frame),
      {name}_1 AS (SELECT frame, [[a / m0[1][1] FOR a IN m0[1]], [m0[2][j] - m0[2][1] * m0[1][j] / m0[1][1] FOR j IN range(1, 5)], [m0[3][j] - m0[3][1] * m0[1][j] / m0[1][1] FOR j IN range(1, 5)]] AS m1 FROM {name}_m),
      {name}_2 AS (SELECT frame, [[m1[1][j] - m1[1][2] * m1[2][j] / m1[2][2] FOR j IN range(1, 5)], [a / m1[2][2] FOR a IN m1[2]], [m1[3][j] - m1[3][2] * m1[2][j] / m1[2][2] FOR j IN range(1, 5)]] AS m2 FROM {name}_1),
      {name} AS (SELECT frame, [m2[1][4] - m2[1][3] * m2[3][4] / m2[3][3], m2[2][4] - m2[2][3] * m2[3][4] / m2[3][3], m2[3][4] / m2[3][3]] AS t FROM {name}_2)"""


def _fit_steps() -> str:
    steps, given = [], "start"
    for i in range(FIT_ROUNDS):
        steps += [_fit_step(f"d{i}", given, "y", "x"), _fit_step(f"a{i}", f"d{i}", "x", "y")]
        given = f"a{i}"
    return ", ".join(steps)


@oracle(f"""
  WITH {around(2)}, b1 AS (SELECT *, ({moved_sum('v', BLUR, 'x')} + 4) >> 3 AS h FROM g), b2 AS (SELECT *, ({moved_sum('h', BLUR, 'y')} + 4) >> 3 AS s FROM b1),
  b3 AS (SELECT frame, y, x, v AS y_, CASE WHEN there THEN s ELSE 0 END AS v, there, {moved_sum('there::INT', [1] * 5, 'x')} AS n FROM b2),
  x AS MATERIALIZED (SELECT frame, y, x, y_, v, there AND {moved_sum('n', [1] * 5, 'y')} = 25 AS whole FROM b3), start AS (SELECT DISTINCT frame, [1, 0, 0]::DOUBLE[] AS t FROM x), {_fit_steps()}
  SELECT frame, i::INTEGER AS i, round(d.t[i + 1], 6) + 0.0 AS down, round(a.t[i + 1], 6) + 0.0 AS across FROM d{FIT_ROUNDS - 1} d JOIN a{FIT_ROUNDS - 1} a USING (frame), range(3) r(i)""")
def plane_separable_fit(spark, d):
    """The symmetric 5 x 5 taps that best undo a blur of each plane, by turns down and across."""
    blocks = _plane(spark, d)
    fits = Y.separable_fit(Y.window_moments(blocks, P.separable(blocks, BLUR, 3), 2), 2, FIT_ROUNDS)
    both = fits.select("frame", F.posexplode(F.arrays_zip("down", "across")).alias("i", "t")).select("frame", "i", "t.down", "t.across")
    return both.withColumns({n: F.round(n, 6) + 0.0 for n in ("down", "across")})


BINS, PULL = 20, 50.0


@oracle(f"""
  WITH RECURSIVE s AS (SELECT l_returnflag, (l_quantity::BIGINT - 1) * {BINS - 1} AS w, floor(l_discount * 100 + 0.5)::BIGINT AS v FROM lineitem),
  q AS (SELECT *, least(w // 49, {BINS - 2}) AS i FROM s), f AS (SELECT *, w - i * 49 AS f FROM q),
  p AS (SELECT l_returnflag, i, j, sum(a * b) / 2401e0 AS s FROM (
      SELECT l_returnflag, i + d AS i, i + e AS j, CASE d WHEN 0 THEN 49 - f ELSE f END AS a, CASE e WHEN 0 THEN 49 - f ELSE f END AS b FROM f, range(2) t(d), range(2) u(e)) GROUP BY ALL
    UNION ALL SELECT l_returnflag, i + d, {BINS}, sum(CASE d WHEN 0 THEN 49 - f ELSE f END * v) / 49e0 FROM f, range(2) t(d) GROUP BY ALL
    UNION ALL SELECT l_returnflag, i + d, i + e, CASE WHEN d = e THEN {PULL}e0 ELSE -{PULL}e0 END FROM (SELECT DISTINCT l_returnflag FROM lineitem), range({BINS - 1}) w(i), range(2) t(d), range(2) u(e)),
  g AS (SELECT l_returnflag, x.i, y.j, coalesce(sum(s), 0)::DOUBLE AS s FROM (SELECT DISTINCT l_returnflag FROM lineitem) l CROSS JOIN range({BINS}) x(i) CROSS JOIN range({BINS + 1}) y(j) LEFT JOIN p USING (l_returnflag, i, j) GROUP BY ALL),
  m AS (SELECT l_returnflag, list(r ORDER BY i) AS m FROM (SELECT l_returnflag, i, list(s ORDER BY j) AS r FROM g GROUP BY ALL) GROUP BY ALL), {eliminated('m', BINS)}
  SELECT l_returnflag, i::INTEGER AS i, round(m[i + 1][{BINS + 1}], 6) + 0.0 AS x FROM e, range({BINS}) t(i) WHERE k = {BINS + 1}""")
def strength_curve(spark, d):
    """Discount by quantity as a curve of 20 coupled places for each flag."""
    rows = load(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), F.floor(F.col("l_discount") * 100 + 0.5).alias("v"))
    curve = Y.strength_curve(rows, ["l_returnflag"], "q", "v", 1, 50, BINS, PULL)
    return curve.select("l_returnflag", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


# ---- quantiles ----

CENTS = "floor({} * 100 + 0.5)"


@oracle(f"SELECT l_returnflag, quantile_disc({CENTS.format('l_extendedprice')}::BIGINT, 0.9) AS cents FROM lineitem GROUP BY 1")
def price_quantiles(spark, d):
    rows = load(spark, d, "lineitem").select("l_returnflag", F.expr(CENTS.format("l_extendedprice")).alias("cents"))
    return E.exact_quantiles(rows, ["l_returnflag"], "cents", 0.9)


# ---- values of a block, places of a block, noise ----

SIZES = list(range(2, 9))
_NEAREST = "list_position([abs(x - y) FOR y IN c], list_min([abs(x - y) FOR y IN c]))"


@oracle(f"""
  WITH RECURSIVE {CELLS}, b AS (SELECT vec_id, list(v ORDER BY i) AS b, min(v) AS low, max(v) AS high FROM cells GROUP BY 1),
  r AS (
    SELECT vec_id, k, b, [low + (2 * i + 1) * (high - low) // (2 * k) FOR i IN range(k)] AS c, 0 AS step, false AS done FROM b, range(2, 9) t(k)
    UNION ALL
    SELECT vec_id, k, b, m AS c, step + 1 AS step, m = c AS done FROM (
      SELECT *, [CASE WHEN n[i] = 0 THEN c[i] ELSE (s[i] + n[i] // 2 - ((s[i] + n[i] // 2) % n[i] + n[i]) % n[i]) // n[i] END FOR i IN range(1, k + 1)]::BIGINT[] AS m FROM (
        SELECT *, [len([j FOR j IN a IF j = i]) FOR i IN range(1, k + 1)] AS n, [coalesce(list_sum([b[j] FOR j IN range(1, 65) IF a[j] = i]), 0)::BIGINT FOR i IN range(1, k + 1)] AS s FROM (
          SELECT *, [{_NEAREST} FOR x IN b] AS a FROM r WHERE NOT done AND step < 50))))
  SELECT vec_id, k::INTEGER AS k, array_to_string(c, ',') AS centroids, step::BIGINT AS steps, list_sum([list_min([abs(x - y) FOR y IN c]) ** 2 FOR x IN b])::BIGINT AS error
  FROM r WHERE done OR step = 50""")
def block_palettes(spark, d):
    """Each block's values in 2 to 8 clusters, each until it settles."""
    found = A.block_kmeans(_blocks(spark, d), "vec_id", SIZES)
    return found.withColumn("centroids", F.array_join("centroids", ","))


STEPS = [4, 2, 1]
REACH = sum(STEPS)


def _stage(before: str, name: str, step: int) -> str:
    """SQL: the best of the last best and the nine sites around it."""
    return f"""{name}_all AS (SELECT q.frame, q.r, q.c, q.dy + s.dy AS dy, q.dx + s.dx AS dx, CASE WHEN s.dy = 0 AND s.dx = 0 THEN -1 ELSE 1 END AS first, sum(abs(t.v - coalesce(p.v, 0)))::BIGINT AS sad
      FROM {before} q CROSS JOIN (SELECT dy, dx FROM (VALUES (-{step}), (0), ({step})) a(dy), (VALUES (-{step}), (0), ({step})) b(dx)) s
      JOIN target t ON t.frame = q.frame AND t.r = q.r AND t.c = q.c LEFT JOIN plane p ON p.frame = q.frame - 1 AND p.y = t.y + q.dy + s.dy AND p.x = t.x + q.dx + s.dx GROUP BY ALL),
      {name} AS (SELECT frame, r, c, dy, dx, sad FROM {name}_all QUALIFY row_number() OVER (PARTITION BY frame, r, c ORDER BY sad, first, dy, dx) = 1)"""


@oracle(f"""
  WITH {PLANE}, tiles AS (SELECT DISTINCT frame + 1 AS frame, y // 64 AS ty, x // 64 AS tx FROM plane),
  target AS (SELECT frame, y // 8 AS r, x // 8 AS c, y, x, v FROM plane SEMI JOIN tiles t ON t.frame = plane.frame AND t.ty = y // 64 AND t.tx = x // 64),
  s0 AS (SELECT DISTINCT frame, r, c, 0::BIGINT AS dy, 0::BIGINT AS dx FROM target), {_stage('s0', 's1', 4)}, {_stage('s1', 's2', 2)}, {_stage('s2', 's3', 1)},
  every AS (SELECT t.frame, t.r, t.c, dy, dx, sum(abs(t.v - coalesce(p.v, 0)))::BIGINT AS sad FROM target t CROSS JOIN range(-{REACH}, {REACH + 1}) a(dy) CROSS JOIN range(-{REACH}, {REACH + 1}) b(dx)
    LEFT JOIN plane p ON p.frame = t.frame - 1 AND p.y = t.y + dy AND p.x = t.x + dx GROUP BY ALL),
  best AS (SELECT frame, r, c, min(sad) AS best_sad FROM every GROUP BY ALL)
  SELECT frame, r, c, dy, dx, sad, best_sad, sad = best_sad AS is_best FROM s3 JOIN best USING (frame, r, c)""")
def plane_staged_search(spark, d):
    """Each block's place in the plane before its own: by stages, and whether a search of all places finds none better."""
    blocks = _plane(spark, d)
    return X.staged_search(blocks, X.displaced(blocks, 1), STEPS).withColumn("is_best", F.col("sad") == F.col("best_sad"))


SEED = 7391


@oracle(f"""
  WITH RECURSIVE s AS (SELECT 0::BIGINT AS n, {SEED}::BIGINT AS state UNION ALL
    SELECT n + 1, (state >> 1) | ((xor(xor(state, state >> 1), xor(state >> 3, state >> 12)) & 1) << 15) FROM s WHERE n < (SELECT max(event_id) FROM events))
  SELECT event_id, state, (state >> 5) - 1024 AS noise FROM events JOIN s ON n = event_id""")
def register_noise(spark, d):
    """Noise of each event from the state that a shift register has after as many steps as its number."""
    state = Z.state_after(SEED, F.col("event_id"))
    rows = load(spark, d, "events").select("event_id", state.alias("state"))
    return rows.withColumn("noise", F.shiftright("state", 5) - 1024)


# ---- transforms ----

#: All sizes with cosines and with another pair of kernels in use for them, and all pairs of one size.
CASES = [*(T.Case(h, w, "cosine", "cosine") for h, w in T.SIZES), *(T.types_of(h, w)[(3 * i + 1) % len(T.types_of(h, w))] for i, (h, w) in enumerate(T.SIZES)), *T.types_of(4, 8)]
LARGE = 90.123
SUMS = [T.Case(n, n, "hadamard", "hadamard") for n in (4, 8, 16, 32)]

KERNEL = """kernel AS (SELECT kind, n, k, j, CASE kind
    WHEN 'cosine' THEN sqrt(CASE WHEN k = 0 THEN 1e0 ELSE 2e0 END / n) * cos((2 * j + 1) * k * pi() / (2 * n))
    WHEN 'hadamard' THEN 1e0 - 2 * (bit_count(k & j) % 2)
    WHEN 'identity' THEN (k = j)::INT::DOUBLE
    ELSE CASE WHEN n = 4 THEN 2e0 / sqrt(9e0) * sin(pi() * (2 * k + 1) * (i + 1) / 9) ELSE sqrt(2e0 / n) * sin(pi() * (2 * k + 1) * (2 * i + 1) / (4 * n)) END END AS weight
  FROM (SELECT *, CASE kind WHEN 'flipped' THEN n - 1 - j ELSE j END AS i FROM (VALUES ('cosine'), ('sine'), ('flipped'), ('identity'), ('hadamard')) a(kind), (VALUES (4), (8), (16), (32), (64)) b(n), range(64) c(k), range(64) d(j) WHERE k < n AND j < n))"""


def coefficients(cases: list[T.Case]) -> str:
    """SQL: t (id, frame, r, c, a, b, t): the coefficients of all whole pieces."""
    rows = ", ".join(f"({i}, {x.height}, {x.width}, '{x.down}', '{x.across}')" for i, x in enumerate(cases))
    return f"""{PLANE}, {KERNEL}, q AS (SELECT * FROM (VALUES {rows}) AS q(id, h, w, down, across)),
      p AS (SELECT id, h, w, down, across, frame, y // h AS r, x // w AS c, y % h AS i, x % w AS j, v, count(*) OVER (PARTITION BY id, frame, y // h, x // w) AS n FROM plane, q),
      s AS (SELECT id, h, down, frame, r, c, i, k AS b, sum(v * weight) AS v FROM (SELECT * FROM p WHERE p.n = h * w) p JOIN kernel ON kind = across AND kernel.n = w AND kernel.j = p.j GROUP BY ALL),
      t AS (SELECT id, frame, r, c, k AS a, b, sum(v * weight) AS t FROM s JOIN kernel ON kind = down AND n = h AND j = i GROUP BY ALL)"""


@oracle(f"WITH {coefficients(CASES)} SELECT frame, id::INTEGER AS \"case\", count(DISTINCT (r, c)) AS n_pieces, count(*) FILTER (abs(t) >= {LARGE}) AS n_large FROM t GROUP BY ALL")
def plane_transform_sizes(spark, d):
    """Large coefficients of all 19 sizes, and of all 16 pairs of kernels."""
    pieces = T.transformed(_plane(spark, d), CASES).select("frame", "case", F.size(F.filter("t", lambda x: F.abs(x) >= LARGE)).alias("n"))
    return pieces.groupBy("frame", "case").agg(F.count("*").alias("n_pieces"), F.sum("n").alias("n_large"))


@oracle(f"""WITH {coefficients(SUMS)}, o AS (SELECT id, frame, r, c, sum(abs(t))::BIGINT AS satd FROM t GROUP BY ALL)
  SELECT frame, (4 << id::INT)::INTEGER AS side, count(*) AS n, sum(satd)::BIGINT AS satd, max(satd) AS most FROM o GROUP BY ALL""")
def plane_hadamard_sizes(spark, d):
    """Sums of absolute Hadamard coefficients at sides 4 to 32."""
    sums = T.transformed(_plane(spark, d), SUMS).select("frame", "case", F.aggregate("t", F.lit(0.0), lambda s, x: s + F.abs(x)).cast("bigint").alias("satd"))
    sums = sums.withColumn("side", F.call_function("shiftleft", F.lit(4), F.col("case")))
    return sums.groupBy("frame", "side").agg(F.count("*").alias("n"), F.sum("satd").alias("satd"), F.max("satd").alias("most"))
