"""DuckDB SQL with the same rows as the queries of the catalogue."""

from __future__ import annotations

from ..operators.blocks import DCT, HADAMARD
from .catalogue import CACHE, EVENT_TYPES, FEATURES, INTERVALS, POINTS, QUANT, SEEDS, STEP

CELLS = """cells AS (
  SELECT vec_id, label, i, i // 8 AS r, i % 8 AS c, CAST(floor(embedding[i + 1]::DOUBLE * 1024 + 0.5) AS BIGINT) AS v
  FROM embeddings, range(64) AS t(i)
)"""
EVENTS = "e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value * 16) AS BIGINT) AS v FROM events)"
Q = "CAST(l_quantity AS BIGINT)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


def leb(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def clamp(x: str, low: int, high: int) -> str:
    return f"least(greatest({x}, {low}), {high})"


def matrix(m) -> str:
    number = lambda x: f"{x!r}e0" if isinstance(x, float) else repr(x)  # noqa: E731  without an exponent DuckDB takes it for a DECIMAL
    return ", ".join(f"({i}, {j}, {number(x)})" for i, row in enumerate(m) for j, x in enumerate(row))


def kmeans() -> str:
    steps = [f"h AS (SELECT {Q} AS value, count(*) AS n FROM lineitem GROUP BY 1), k0 AS (SELECT * FROM (VALUES {values(enumerate(SEEDS))}) AS t(k, c))"]
    for i in range(1, 4):
        steps.append(
            f"a{i} AS (SELECT value, n, arg_min(k, (abs(value - c), k)) AS k FROM h, k{i - 1} GROUP BY value, n), "
            f"s{i} AS (SELECT k, sum(value * n)::BIGINT AS s, sum(n)::BIGINT AS n FROM a{i} GROUP BY k), "
            f"k{i} AS (SELECT p.k, coalesce((s + n // 2) // n, p.c) AS c FROM k{i - 1} p LEFT JOIN s{i} USING (k))"
        )
    steps.append("a4 AS (SELECT value, n, arg_min(k, (abs(value - c), k)) AS k FROM h, k3 GROUP BY value, n)")
    return f"WITH {', '.join(steps)} SELECT a4.k::INTEGER AS cluster, any_value(c)::BIGINT AS centroid, sum(n)::BIGINT AS n FROM a4 JOIN k3 USING (k) GROUP BY a4.k"


def first_interval() -> str:
    cases = " ".join(f"WHEN ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' THEN {i}" for i, a, b in INTERVALS)
    return f"SELECT event_id, (CASE {cases} END)::INTEGER AS idx FROM events"


def scaling() -> str:
    cases = [f"WHEN x < {POINTS[0][0]} THEN {POINTS[0][1]}"]
    for (x0, y0), (x1, y1) in zip(POINTS, POINTS[1:], strict=False):
        cases.append(f"WHEN x < {x1} THEN {y0} + (((x - {x0}) * ({y1 - y0} * ((65536 + ({x1} - {x0}) // 2) // ({x1} - {x0}))) + 32768) >> 16)")
    return f"SELECT event_id, x, (CASE {' '.join(cases)} ELSE {POINTS[-1][1]} END)::BIGINT AS y FROM (SELECT event_id, {clamp('floor(value)::BIGINT', 0, 255)} AS x FROM events)"


def rd() -> str:
    options = " UNION ALL ".join(
        f"SELECT p_partkey, {i} AS candidate, ((({i + 1} * (p_size + 100)) * 300 + 256) >> 9) + (((p_size * {37 + i} + p_partkey) % 211 * {5 - i}) << 7) AS cost FROM p" for i in range(5)
    )
    return f"WITH p AS (SELECT p_partkey, p_size::BIGINT AS p_size FROM part), o AS ({options}) SELECT p_partkey, arg_min(candidate, (cost, candidate))::INTEGER AS candidate, min(cost)::BIGINT AS cost FROM o GROUP BY 1"


def pick(name: str) -> str:
    a, b = QUANT[name]
    return f"(CASE WHEN i = 0 THEN {a} ELSE {b} END)"


QUANTISED = f"""{CELLS}, t AS (
  SELECT *, {clamp(f"abs(v) + {pick('rounding')}", -32768, 32767)} * 32 AS t FROM cells
), m AS (
  SELECT *, CASE WHEN abs(v) < {pick('zbin')} THEN 0 ELSE sign(v) * ((((t * {pick('quant')}) >> 16) + t) * {pick('shift')} >> 21) END AS q FROM t
)"""


def moved(dr: int, dc: int) -> str:
    return f"LEFT JOIN lv n{dr}{dc} ON n{dr}{dc}.vec_id = a.vec_id AND n{dr}{dc}.r = a.r + {dr} AND n{dr}{dc}.c = a.c + {dc}"


NEAR = [(0, 1), (1, 0), (1, 1), (0, 2), (2, 0)]

#: A direction's lines: from row to row by halves of a column's number, or from column to column by halves of a row's.
LINES = [*(f"r + {h} * (c * {abs(h)} // 2) // {max(abs(h), 1)}" for h in (2, 1, 0, -1)), *(f"c + {h} * (r * {abs(h)} // 2) // {max(abs(h), 1)}" for h in (-2, -1, 0, 1))]

GRADIENTS = f"""{CELLS}, w AS (
  SELECT *, lead(v) OVER (PARTITION BY vec_id, r ORDER BY c) - lag(v) OVER (PARTITION BY vec_id, r ORDER BY c) AS dx,
    lead(v) OVER (PARTITION BY vec_id, c ORDER BY r) - lag(v) OVER (PARTITION BY vec_id, c ORDER BY r) AS dy FROM cells
), g AS (SELECT * FROM w WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6)"""


def node_level(side: int) -> str:
    bits = 2 * (side.bit_length() - 1)
    return (
        f"SELECT vec_id, {side} AS side, (r // {side}) * {8 // side} + c // {side} AS node, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS ss, {bits} AS bits FROM cells GROUP BY ALL"
    )


NODES = f"{CELLS}, n AS ({' UNION ALL '.join(node_level(s) for s in (2, 4, 8))})"

ADAPT = ", ".join(f"CASE WHEN {i} < symbol THEN e{i} + (32768 - e{i}) // (1 << (5 + (k >> 4))) ELSE e{i} - e{i} // (1 << (5 + (k >> 4))) END" for i in range(4))

ORACLES: dict[str, str] = {
    "top_values_per_brand": f"""
      SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, value))::INTEGER AS rank, value, n
      FROM (SELECT p_brand, {Q} AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) QUALIFY rank <= 4""",
    "hist_values": f"SELECT {Q} AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "hist_dual_bins": f"SELECT {Q} >> 2 AS bin, count(*) AS n, count(DISTINCT {Q}) AS n_distinct FROM lineitem GROUP BY 1",
    "dedup_sorted": "SELECT p_brand, count(DISTINCT p_size) AS n_values, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS values FROM part GROUP BY 1",
    "symbol_cost": """
      WITH s AS (SELECT event_type, floor(-log2(count(*) / (SELECT count(*) FROM events)::DOUBLE) * 512 + 0.5)::BIGINT AS bits FROM events GROUP BY 1)
      SELECT user_id, count(*) AS n, sum(bits)::BIGINT AS cost FROM events JOIN s USING (event_type) GROUP BY 1""",
    "census_counters": """
      SELECT 'order_status' AS metric, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
      UNION ALL SELECT 'return_flag', l_returnflag || '/' || l_linestatus, count(*) FROM lineitem GROUP BY 2""",
    "snap_to_cache": f"""
      WITH h AS (SELECT {Q} AS value, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT * FROM (VALUES {values(enumerate(CACHE))}) AS t(i, c))
      SELECT value, n, arg_min(i, (abs(value - c), i))::INTEGER AS idx, arg_min(c, (abs(value - c), i))::BIGINT AS snapped, min(abs(value - c))::BIGINT AS distance
      FROM h, k GROUP BY value, n""",
    "kmeans_3_steps": kmeans(),
    "nearest_centroid": f"""
      WITH {CELLS}, f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1),
      k AS (SELECT cells.label AS l, i, v AS w FROM cells JOIN f USING (vec_id)),
      d AS (SELECT vec_id, l, sum((v - w) * (v - w))::BIGINT AS d FROM cells JOIN k USING (i) GROUP BY ALL)
      SELECT vec_id, arg_min(l, (d, l)) AS centroid, min(d) AS distance FROM d GROUP BY 1""",
    "cached_vs_new": """
      SELECT p_brand, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AS cached, count(*) AS n FROM part GROUP BY ALL""",
    "merge_palettes": """
      SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size))::INTEGER AS position, p_size, bool_or(p_partkey % 3 = 0) AS in_a
      FROM part WHERE p_partkey % 3 < 2 GROUP BY p_brand, p_size""",
    "bucket_join_capped": """
      WITH k AS (SELECT l_partkey % 65536 AS bucket, l_partkey, l_suppkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey % 65536 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 256),
      a AS (SELECT bucket, l_partkey, l_suppkey, count(*) AS kept FROM k GROUP BY ALL),
      b AS (SELECT l_partkey % 65536 AS bucket, l_partkey, l_suppkey, count(*) AS probes FROM lineitem GROUP BY ALL)
      SELECT bucket, sum(coalesce(kept, 0))::BIGINT AS n_kept, sum(probes)::BIGINT AS n_probes, sum(coalesce(kept, 0) * probes)::BIGINT AS n_matches
      FROM b LEFT JOIN a USING (bucket, l_partkey, l_suppkey) GROUP BY 1""",
    "interval_lookup": first_interval(),
    "scaling_lut": scaling(),
    "segment_features": f"""
      WITH f AS (SELECT * FROM (VALUES {values(FEATURES.items())}) AS t(s, d))
      SELECT (c_custkey % 8)::INTEGER AS segment, {clamp('c_nationkey * 9 + coalesce(d, 0)', 0, 255)} AS q, count(*) AS n, min(c_custkey) AS first_custkey
      FROM customer LEFT JOIN f ON c_custkey % 8 = s GROUP BY ALL""",
    "rd_argmin": rd(),
    "block_sad_sse_var": f"""
      WITH {CELLS}, p AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) AS other_id FROM embeddings)
      SELECT p.vec_id, other_id, sum(abs(a.v - b.v))::BIGINT AS sad, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS sse,
        (sum((a.v - b.v) * (a.v - b.v)) - ((sum(a.v - b.v)::BIGINT * sum(a.v - b.v)::BIGINT) >> 6))::BIGINT AS variance
      FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i GROUP BY ALL""",
    "hadamard_satd": f"""
      WITH {CELLS}, m AS (SELECT * FROM (VALUES {matrix(HADAMARD)}) AS t(k, j, w)),
      h AS (SELECT vec_id, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL),
      t AS (SELECT vec_id, m.k AS kr, h.k AS kc, sum(x * w) AS x FROM h JOIN m ON r = j GROUP BY ALL)
      SELECT vec_id, sum(abs(x))::BIGINT AS satd, sum(CASE WHEN kr = 0 AND kc = 0 THEN x END)::BIGINT AS dc FROM t GROUP BY 1""",
    "deadzone_quantize": f"""
      WITH {QUANTISED} SELECT vec_id, count(*) FILTER (q <> 0) AS n_levels, sum(abs(q))::BIGINT AS sum_levels,
        coalesce(max(i + 1) FILTER (q <> 0), 0)::BIGINT AS eob FROM m GROUP BY 1""",
    "dequant_error": f"""
      WITH {QUANTISED}, b AS (SELECT vec_id, v, v - q * (CASE WHEN i = 0 THEN {STEP[0]} ELSE {STEP[1]} END) AS d FROM m)
      SELECT vec_id, sum(d * d)::BIGINT AS error, sum(v * v)::BIGINT AS energy FROM b GROUP BY 1""",
    "scan_eob": f"""
      WITH {CELLS}, s AS (SELECT i, row_number() OVER (ORDER BY i // 8 + i % 8, CASE WHEN (i // 8 + i % 8) % 2 = 0 THEN i // 8 ELSE -(i // 8) END) AS n FROM range(64) AS t(i))
      SELECT vec_id, coalesce(max(n) FILTER (abs(v) >> 7 <> 0), 0)::BIGINT AS eob, coalesce(max(i + 1) FILTER (abs(v) >> 7 <> 0), 0)::BIGINT AS raster_eob
      FROM cells JOIN s USING (i) GROUP BY 1""",
    "nz_neighbours": f"""
      WITH {CELLS}, lv AS (SELECT vec_id, r, c, least(abs(v) >> 6, 3) AS v FROM cells),
      x AS (SELECT a.vec_id, a.r, a.c, least(({' + '.join(f'coalesce(n{r}{c}.v, 0)' for r, c in NEAR)} + 1) >> 1, 4) AS ctx FROM lv a {' '.join(moved(*d) for d in NEAR)})
      SELECT vec_id, sum(ctx)::BIGINT AS total, max(ctx) AS most, max(ctx) FILTER (r = 0 AND c = 0) AS first FROM x GROUP BY 1""",
    "box_sum_5x5": f"""
      WITH {CELLS}, h AS (SELECT vec_id, r, c, sum(v) OVER (PARTITION BY vec_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM cells),
      b AS (SELECT vec_id, r, c, (sum(v) OVER (PARTITION BY vec_id, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))::BIGINT AS v FROM h)
      SELECT vec_id, sum(v)::BIGINT AS total, min(v) AS low, max(v) AS high, max(v) FILTER (r = 3 AND c = 3) AS centre FROM b GROUP BY 1""",
    "fir_separable": f"""
      WITH {CELLS}, k AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS t(d, w)),
      h AS (SELECT a.vec_id, a.r, a.c, (sum(b.v * w)::BIGINT + 8) >> 4 AS v FROM cells a, k, cells b
        WHERE b.vec_id = a.vec_id AND b.r = a.r AND b.c = {clamp('a.c + d', 0, 7)} GROUP BY ALL),
      f AS (SELECT a.vec_id, a.r, a.c, (sum(b.v * w)::BIGINT + 8) >> 4 AS v FROM h a, k, h b
        WHERE b.vec_id = a.vec_id AND b.c = a.c AND b.r = {clamp('a.r + d', 0, 7)} GROUP BY ALL)
      SELECT vec_id, sum(v)::BIGINT AS total, min(v) AS low, max(v) AS high, max(v) FILTER (r = 0 AND c = 0) AS corner FROM f GROUP BY 1""",
    "gradient_hist": f"""
      WITH {GRADIENTS}, b AS (
        SELECT label, {clamp('dy * 4 // dx + 4', 0, 7)} AS bin, abs(dx) + abs(dy) AS w FROM g WHERE dx <> 0
        UNION ALL SELECT label, o, (abs(dx) + abs(dy)) // 2 FROM g, (VALUES (0), (7)) AS t(o) WHERE dx = 0)
      SELECT label, bin::BIGINT AS bin, sum(w)::BIGINT AS total FROM b GROUP BY ALL""",
    "dominant_direction": f"""
      WITH {CELLS}, l AS ({' UNION ALL '.join(f'SELECT vec_id, {d} AS d, {line} AS line, v FROM cells' for d, line in enumerate(LINES))}),
      s AS (SELECT vec_id, d, line, sum(v)::BIGINT AS s, count(*) AS n FROM l GROUP BY ALL),
      k AS (SELECT vec_id, d, sum(s * s * (840 // n))::BIGINT AS cost FROM s GROUP BY ALL),
      b AS (SELECT vec_id, arg_min(d, (-cost, d)) AS direction, max(cost) AS best FROM k GROUP BY 1)
      SELECT b.vec_id, direction::INTEGER AS direction, (best - cost) >> 10 AS gap FROM b JOIN k ON k.vec_id = b.vec_id AND k.d = (direction + 4) % 8""",
    "variance_rollup": f"WITH {NODES} SELECT vec_id, side, node::INTEGER AS node, ((ss - ((s * s) >> bits)) * 256) >> bits AS variance FROM n",
    "split_or_not": f"""
      WITH {NODES}, w AS (SELECT vec_id, side, node, ss - ((s * s) >> bits) AS cost FROM n),
      s4 AS (SELECT vec_id, (node // 8) * 2 + node % 4 // 2 AS node, 6000 + sum(cost) AS split FROM w WHERE side = 2 GROUP BY ALL),
      b4 AS (SELECT vec_id, 6000 + sum(least(cost, split)) AS split, count(*) FILTER (split < cost) AS n FROM w JOIN s4 USING (vec_id, node) WHERE side = 4 GROUP BY 1)
      SELECT vec_id, least(cost, split)::BIGINT AS cost, split < cost AS split_8, n AS n_split_4 FROM w JOIN b4 USING (vec_id) WHERE side = 8""",
    "octile_variance": f"""
      WITH {CELLS}, v AS (SELECT vec_id, vec_id // 64 AS superblock, ((sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT) >> 6 AS v FROM cells GROUP BY ALL),
      a AS (SELECT superblock, list_sort(list(v)) AS a FROM v GROUP BY 1)
      SELECT superblock, (a[32] + 2 * a[40] + a[48] + 2) // 4 AS octile FROM a WHERE len(a) >= 48""",
    "flat_blocks": f"""
      WITH {GRADIENTS}, t AS (SELECT vec_id, sum(dx * dx)::BIGINT AS xx, sum(dx * dy)::BIGINT AS xy, sum(dy * dy)::BIGINT AS yy FROM g GROUP BY 1),
      s AS (SELECT vec_id, (sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT AS variance FROM cells GROUP BY 1),
      e AS (SELECT vec_id, xx + yy AS trace, sqrt(((xx - yy) * (xx - yy) + xy * xy * 4)::DOUBLE) AS root, variance FROM t JOIN s USING (vec_id)),
      f AS (SELECT vec_id, trace, round((trace + root) / 2, 3) AS e1, round((trace - root) / 2, 3) AS e2, variance FROM e)
      SELECT *, trace < 1500000 AND e1 < e2 * 1.5 AND variance > 500000 AS flat FROM f""",
    "dct_8x8": f"""
      WITH {CELLS}, m AS (SELECT k, j, w::DOUBLE AS w FROM (VALUES {matrix(DCT)}) AS t(k, j, w)),
      h AS (SELECT vec_id, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL),
      t AS (SELECT vec_id, m.k AS kr, h.k AS kc, sum(x * w) AS x FROM h JOIN m ON r = j GROUP BY ALL)
      SELECT vec_id, (kr * 8 + kc)::INTEGER AS k, round(x, 5) + 0.0 AS coef FROM t""",
    "freq_energy": f"""
      WITH {CELLS}, m AS (SELECT k, j, w::DOUBLE AS w FROM (VALUES {matrix(DCT)}) AS t(k, j, w)),
      h AS (SELECT vec_id, label, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL),
      e AS (SELECT vec_id, label, k, sum(x * x) AS e FROM h GROUP BY ALL),
      u AS (SELECT vec_id, label, k, sum(e) OVER (PARTITION BY vec_id ORDER BY k DESC) AS e FROM e)
      SELECT label, k::INTEGER AS freq, round(sum(e), 3) AS energy FROM u WHERE k >= 1 GROUP BY ALL""",
    "leb128_sizes": f"SELECT ({leb('o_orderkey')})::BIGINT AS size, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1",
    "tile_offsets": f"""
      WITH s AS (SELECT o_orderkey, ({leb('o_orderkey')} + length(o_orderpriority))::BIGINT AS size FROM orders)
      SELECT o_orderkey, size, (sum(size) OVER (ORDER BY o_orderkey) - size)::BIGINT AS offset FROM s""",
    "delta_code": """
      SELECT p_brand, p_size, (p_size - coalesce(lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size), 0))::BIGINT AS delta
      FROM (SELECT DISTINCT p_brand, p_size FROM part)""",
    "cdf_adapt": f"""
      WITH RECURSIVE {EVENTS}, s AS (
        SELECT user_id, day, list_position({EVENT_TYPES!r}, event_type) - 1 AS symbol, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS n FROM e
      ), f AS (
        SELECT DISTINCT user_id, day, 0::BIGINT AS n, 0 AS k, {', '.join(f'{32768 - 32768 * (i + 1) // 5}::BIGINT AS e{i}' for i in range(4))} FROM s
        UNION ALL SELECT f.user_id, f.day, s.n, least(k + 1, 32), {ADAPT} FROM f JOIN s ON s.user_id = f.user_id AND s.day = f.day AND s.n = f.n + 1
      )
      SELECT user_id, day, n, e0, e1, e2, e3 FROM f WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY user_id, day)""",
    "candidate_stack": f"""
      WITH a AS (SELECT l_orderkey, l_suppkey % 5 AS key, sum({Q})::BIGINT AS w, min(l_linenumber) AS came FROM lineitem GROUP BY ALL),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY came, key) <= 8),
      c AS (SELECT l_orderkey, key, came, came > 2 AS far, w + CASE WHEN came <= 2 THEN 640 ELSE 0 END AS weight FROM b)
      SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY far, weight DESC, came, key))::INTEGER AS rank, key, weight FROM c""",
    "last_writer_grid": """
      SELECT user_id % 4 AS cell_r, hour(ts)::INTEGER AS cell_c, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY ALL""",
    "slot_states": """
      SELECT user_id, (event_id % 8)::INTEGER AS slot, count(*) AS n_writes, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL""",
    "edge_masks": f"""
      WITH {EVENTS}, w AS (SELECT user_id, {', '.join(f'lag(v, {i}) OVER o AS p{i - 1}' for i in range(1, 5))}, v AS q0, {', '.join(f'lead(v, {i}) OVER o AS q{i}' for i in range(1, 4))}
        FROM e WINDOW o AS (PARTITION BY user_id, day ORDER BY event_id)),
      m AS (SELECT user_id, CASE WHEN p3 IS NOT NULL AND q3 IS NOT NULL THEN
        {' AND '.join(f'abs({s}{i} - {s}{i + 1}) <= 900' for s in 'pq' for i in range(3))} AND abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= 2400 END AS masked FROM w)
      SELECT user_id, count(masked) AS n, count(*) FILTER (masked) AS n_smooth FROM m GROUP BY 1""",
    "autocov_window": f"""
      WITH {EVENTS}, p AS ({' UNION ALL '.join(f'SELECT user_id, day, {k} AS lag, v * lag(v, {k}) OVER (PARTITION BY user_id, day ORDER BY event_id) AS xy FROM e' for k in range(4))})
      SELECT user_id, day, lag, count(xy) AS n, sum(xy)::BIGINT AS xy FROM p WHERE xy IS NOT NULL GROUP BY ALL""",
    "noise_strength_bins": f"""
      WITH x AS (SELECT {clamp(f'{Q} - 1', 0, 49)} AS p, floor(l_discount * 100 + 0.5)::BIGINT AS s FROM lineitem),
      i AS (SELECT least(p // 7, 6) AS bin, p - least(p // 7, 6) * 7 AS a, s FROM x)
      SELECT bin, count(*) AS n, sum((7 - a) * (7 - a))::BIGINT AS m00, sum((7 - a) * a)::BIGINT AS m01, sum(a * a)::BIGINT AS m11, sum((7 - a) * s)::BIGINT AS b0, sum(a * s)::BIGINT AS b1
      FROM i GROUP BY 1""",
    "upscale_1d": f"""
      WITH {EVENTS}, h AS (SELECT day, hour(ts) AS hour, sum(v)::BIGINT AS v FROM e GROUP BY ALL),
      n AS (SELECT day, v, coalesce(lead(v) OVER o, v) AS w, row_number() OVER o - 1 AS place FROM h WINDOW o AS (PARTITION BY day ORDER BY hour))
      SELECT day, place * 2 AS pos, v AS value FROM n UNION ALL SELECT day, place * 2 + 1, (v + w + 1) >> 1 FROM n""",
    "round_shift_levels": "SELECT (p_partkey + 16) >> 5 AS level, count(*) AS n FROM part GROUP BY 1",
}
