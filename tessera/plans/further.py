"""Further queries of the catalogue, each with its SQL: contexts, models, filters, choices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import models as M
from ..functions.fixed import clamp
from ..operators import blocks as B
from ..operators import filters as X
from ..operators import grids as G
from ..operators import quantiles as E
from ..operators import sequences as S
from ..sources.tables import load
from .catalogue import _blocks, _events
from .more import PAIRS, _pairs, oracle
from .sql import CELLS, EVENTS
from .sql import clamp as sql_clamp

GRID = """g AS (SELECT vec_id, label, vec_id // 256 AS frame, vec_id // 16 % 16 AS r, vec_id % 16 AS c FROM embeddings)"""


def beside(values: dict[str, str]) -> str:
    """SQL: the grid with the neighbours of some expressions."""
    one = ", ".join(f"{x} AS {k}" for k, x in values.items())
    up = ", ".join(f"lag({k}) OVER (PARTITION BY frame, c ORDER BY r) AS {k}_up" for k in values)
    left = ", ".join(f"lag({k}) OVER a AS {k}_left, lag({k}_up) OVER a AS {k}_up_left" for k in values)
    return f"{GRID}, v AS (SELECT *, {one} FROM g), u AS (SELECT *, {up} FROM v), n AS (SELECT *, {left} FROM u WINDOW a AS (PARTITION BY frame, r ORDER BY c))"


def _grid(spark, d, values):
    place = {"frame": F.expr("vec_id div 256"), "r": F.expr("vec_id div 16 % 16"), "c": F.expr("vec_id % 16")}
    rows = load(spark, d, "embeddings").select("vec_id", "label").withColumns(place).withColumns(values)
    return G.with_neighbours(rows, "frame", "r", "c", list(values))


# ---- neighbours ----


@oracle(f"""
  WITH {beside({'s': '(vec_id * 7 + label) % 3'})}
  SELECT CASE WHEN s_up_left = s_up THEN s_up ELSE coalesce(s_left, s_up, 0) END AS prediction,
    CASE WHEN s_up_left IS NULL THEN 0 WHEN s_up_left = s_up AND s_up_left = s_left THEN 2 WHEN s_up_left = s_up OR s_up_left = s_left OR s_up = s_left THEN 1 ELSE 0 END AS context,
    count(*) AS n, count(*) FILTER (s = CASE WHEN s_up_left = s_up THEN s_up ELSE coalesce(s_left, s_up, 0) END) AS n_right FROM n GROUP BY ALL""")
def segment_prediction(spark, d):
    rows = _grid(spark, d, {"s": (F.col("vec_id") * 7 + F.col("label")) % 3})
    prediction, context = G.segment_prediction(F.col("s_up"), F.col("s_left"), F.col("s_up_left"))
    rows = rows.select("s", prediction.alias("prediction"), context.alias("context"))
    return rows.groupBy("prediction", "context").agg(F.count("*").alias("n"), F.count_if(F.col("s") == F.col("prediction")).alias("n_right"))


@oracle(f"""
  WITH {beside({'a': 'vec_id % 5', 'b': 'label % 4'})},
  x AS (SELECT vec_id, unnest([a_up, CASE WHEN a_up > 0 AND b_up > 0 THEN b_up END, a_left, CASE WHEN a_left > 0 AND b_left > 0 THEN b_left END]) AS f FROM n)
  SELECT f::INTEGER AS frame, count(*) AS n FROM x WHERE f > 0 GROUP BY 1""")
def neighbour_reference_counts(spark, d):
    rows = _grid(spark, d, {"a": F.col("vec_id") % 5, "b": F.col("label") % 4})
    pairs = [(F.col(f"a_{side}"), F.col(f"b_{side}")) for side in ("up", "left")]
    counts = rows.select(F.posexplode(G.reference_counts(pairs, 5)).alias("frame", "n"))
    return counts.filter("n > 0").groupBy("frame").agg(F.sum("n").alias("n"))


#: The context that a neighbour's mode gives, by mode.
MODE_CONTEXTS = [0, 1, 2, 3, 4, 4, 4, 4, 3, 0, 1, 2, 0]


@oracle(f"""
  WITH {beside({'m': '(vec_id * 5 + label) % 13', 'p': 'vec_id % 3'})}
  SELECT ({MODE_CONTEXTS!r})[coalesce(m_up, 0) + 1] AS above, ({MODE_CONTEXTS!r})[coalesce(m_left, 0) + 1] AS beside,
    coalesce((p_up > 0)::INT, 0) + coalesce((p_left > 0)::INT, 0) AS palettes, count(*) AS n FROM n GROUP BY ALL""")
def mode_contexts(spark, d):
    rows = _grid(spark, d, {"m": (F.col("vec_id") * 5 + F.col("label")) % 13, "p": F.col("vec_id") % 3})
    of = lambda mode: F.array(*map(F.lit, MODE_CONTEXTS))[F.coalesce(mode, F.lit(0)).cast("int")]
    keys = (of(F.col("m_up")).alias("above"), of(F.col("m_left")).alias("beside"), G.present(F.col("p_up") > 0, F.col("p_left") > 0).alias("palettes"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


@oracle(f"""
  WITH {beside({'w': '8 << (vec_id % 4)::INT', 'h': '8 << (label % 4)::INT', 'k': 'vec_id % 2'})}
  SELECT coalesce((w_up < w)::INT, 0) + 2 * coalesce((h_left < h)::INT, 0) AS partition_context, coalesce(k_up, 0) + coalesce(k_left, 0) AS skip_context, count(*) AS n
  FROM n GROUP BY ALL""")
def partition_contexts(spark, d):
    size = lambda x: F.call_function("shiftleft", F.lit(8), (x % 4).cast("int"))
    rows = _grid(spark, d, {"w": size(F.col("vec_id")), "h": size(F.col("label")), "k": F.col("vec_id") % 2})
    sizes = G.present(F.col("w_up") < F.col("w")) + G.present(F.col("h_left") < F.col("h")) * 2
    return rows.groupBy(sizes.alias("partition_context"), G.present(F.col("k_up") == 1, F.col("k_left") == 1).cast("bigint").alias("skip_context")).agg(F.count("*").alias("n"))


# ---- predicates and geometry ----

SIZES = "b AS (SELECT *, 4 << (p_size % 6) AS w, 4 << (p_partkey % 6)::INT AS h, p_partkey % 13 AS mode FROM part)"


def _sizes(spark, d):
    size = lambda x: F.call_function("shiftleft", F.lit(4), (x % 6).cast("int"))
    return load(spark, d, "part").withColumns({"w": size(F.col("p_size")), "h": size(F.col("p_partkey")), "mode": F.col("p_partkey") % 13})


@oracle(f"""
  WITH {SIZES} SELECT p_brand, count(*) FILTER (w <= 32 AND h <= 32) AS n_luma_guided, count(*) FILTER (w <= 64 AND h <= 64 AND w >= 8 AND h >= 8) AS n_palette,
    count(*) FILTER (mode BETWEEN 1 AND 8 AND w >= 8 AND h >= 8) AS n_angles FROM b GROUP BY 1""")
def legal_modes(spark, d):
    large = (F.col("w") >= 8) & (F.col("h") >= 8)
    within = lambda most: (F.col("w") <= most) & (F.col("h") <= most)
    return _sizes(spark, d).groupBy("p_brand").agg(F.count_if(within(32)).alias("n_luma_guided"), F.count_if(within(64) & large).alias("n_palette"), F.count_if(F.col("mode").between(1, 8) & large).alias("n_angles"))


@oracle(f"""
  WITH {SIZES}, o AS (SELECT *, p_partkey % 64 AS y, p_size AS x FROM b)
  SELECT w, h, count(*) AS n, count(*) FILTER ((y % 2 = 1 OR h // 4 % 2 = 0) AND (x % 2 = 1 OR w // 4 % 2 = 0)) AS n_420, count(*) FILTER (x % 2 = 1 OR w // 4 % 2 = 0) AS n_422,
    max(greatest(w // 2, 4) * greatest(h // 2, 4))::BIGINT AS chroma FROM o GROUP BY ALL""")
def chroma_blocks(spark, d):
    rows = _sizes(spark, d)
    of = lambda sub_y: M.is_chroma_block(F.col("p_partkey") % 64, F.col("p_size"), F.shiftright("w", 2), F.shiftright("h", 2), 1, sub_y)
    area = F.greatest(F.shiftright("w", 1), F.lit(4)) * F.greatest(F.shiftright("h", 1), F.lit(4))
    return rows.groupBy("w", "h").agg(F.count("*").alias("n"), F.count_if(of(1)).alias("n_420"), F.count_if(of(0)).alias("n_422"), F.max(area).cast("bigint").alias("chroma"))


#: Transform types (bits) that a class of sizes may use, within pictures and between them.
TYPE_MASKS = {"small": (0x7F, 0xFFFF), "middle": (0x0F, 0x0FFF), "large": (0x01, 0x0201), "largest": (0x01, 0x01)}


@oracle(f"""
  WITH {SIZES}, k AS (SELECT p_brand, p_partkey % 2 AS inter, greatest(w, h) AS m FROM b),
  t AS (SELECT p_brand, CASE WHEN m > 32 THEN 1 WHEN m > 16 THEN CASE inter WHEN 1 THEN 513 ELSE 1 END WHEN m > 8 THEN CASE inter WHEN 1 THEN 4095 ELSE 15 END ELSE CASE inter WHEN 1 THEN 65535 ELSE 127 END END AS mask FROM k)
  SELECT p_brand, sum(bit_count(mask))::BIGINT AS n_types, bit_and(mask)::BIGINT AS common FROM t GROUP BY 1""")
def transform_type_mask(spark, d):
    most = F.greatest("w", "h")
    of = lambda name: F.when(F.col("p_partkey") % 2 == 1, TYPE_MASKS[name][1]).otherwise(TYPE_MASKS[name][0])
    mask = F.when(most > 32, of("largest")).when(most > 16, of("large")).when(most > 8, of("middle")).otherwise(of("small"))
    rows = _sizes(spark, d).select("p_brand", mask.cast("bigint").alias("mask"))
    return rows.groupBy("p_brand").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("n_types"), F.bit_and("mask").alias("common"))


@oracle("""
  WITH v AS (SELECT l_suppkey, l_linenumber * 64 AS r, l_partkey % 512 AS c, -(l_orderkey % 300) AS dr, (l_partkey * 7 + l_orderkey) % 400 - 200 AS dc FROM lineitem)
  SELECT l_suppkey, count(*) AS n, count(*) FILTER (r + dr >= 0 AND c + dc >= 0 AND c + dc + 8 <= 512 AND (dr <= -8 OR dc <= -8)
    AND ((r + dr + 7) // 64 < r // 64 OR c + dc + 8 <= c // 64 * 64 - 256)) AS n_valid FROM v GROUP BY 1""")
def valid_vectors(spark, d):
    """Vectors whose source lies in the tile, apart from the block itself, and in rows done or 256 columns behind."""
    v = load(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") * 64).alias("r"), (F.col("l_partkey") % 512).alias("c"), (-(F.col("l_orderkey") % 300)).alias("dr"), ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 400 - 200).alias("dc"))
    inside = F.expr("r + dr >= 0 AND c + dc >= 0 AND c + dc + 8 <= 512 AND (dr <= -8 OR dc <= -8)")
    done = F.expr("shiftright(r + dr + 7, 6) < shiftright(r, 6) OR c + dc + 8 <= shiftright(c, 6) * 64 - 256")
    return v.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(inside & done).alias("n_valid"))


# ---- models and tables ----

STEPS = "s AS (SELECT q, 4 + q + ((q * q) >> 7) AS step FROM range(256) AS t(q))"


def _steps(spark):
    q = F.col("id")
    return spark.range(256).select(q.alias("q"), (4 + q + F.shiftright(q * q, 7)).alias("step"))


@oracle(f"""
  WITH {STEPS}, k AS (SELECT *, length(bin(step)) - 1 AS high, CASE WHEN q = 0 THEN 64 WHEN step < 148 THEN 84 ELSE 80 END AS zone FROM s)
  SELECT q, step, (1::BIGINT << (high + 16)) // step + 1 - 65536 AS quant, 1::BIGINT << (16 - high) AS shift, (zone * step + 64) >> 7 AS zbin,
    (CASE WHEN q = 0 THEN 64 ELSE 48 END * step) >> 7 AS round, 65536 // step AS quant_fp, (step * 64) >> 7 AS round_fp, count(*) AS n
  FROM k JOIN part ON {sql_clamp('p_size * 5 + p_partkey % 7 - 3', 0, 255)} = q GROUP BY ALL""")
def quantiser_tables(spark, d):
    table = _steps(spark)
    table = table.withColumns(M.quantiser_row(F.col("step"), F.col("q")))
    q = clamp(F.col("p_size") * 5 + F.col("p_partkey") % 7 - 3, 0, 255)
    counts = load(spark, d, "part").groupBy(q.alias("q")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(table), "q")


@oracle(f"""
  WITH {STEPS}, p AS (SELECT CASE WHEN p_size % 64 < 62 THEN p_size % 64 * 4 ELSE p_size % 64 * 6 - 123 END AS q FROM part)
  SELECT q, floor((3.3e0 + 0.0015e0 * q) * step * step)::BIGINT AS lambda, (floor((3.3e0 + 0.0015e0 * q) * step * step)::BIGINT) >> 6 AS per_bit, count(*) AS n FROM p JOIN s USING (q) GROUP BY ALL""")
def lambda_of_quality(spark, d):
    q = M.quality_index(F.col("p_size") % 64)
    counts = load(spark, d, "part").groupBy(q.alias("q")).agg(F.count("*").alias("n"))
    weight = F.floor((F.lit(3.3) + F.lit(0.0015) * F.col("q")) * F.col("step") * F.col("step"))
    return counts.join(F.broadcast(_steps(spark)), "q").select("q", weight.alias("lambda"), F.shiftright(weight, 6).alias("per_bit"), "n")


LAPLACIAN = M.interpolated_laplacian()


@oracle(f"""
  WITH {CELLS}, v AS (SELECT vec_id, (sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT AS v, 8 + vec_id % 40 AS step FROM cells GROUP BY ALL),
  t AS (SELECT ({[p[0] for p in LAPLACIAN]}) AS xs, ({[p[1] for p in LAPLACIAN]}) AS rs, ({[p[2] for p in LAPLACIAN]}) AS ds),
  x AS (SELECT *, least((((step * step) << 16) + (v >> 1)) // v, {LAPLACIAN[-2][0]})::BIGINT AS x FROM v, t WHERE v > 0),
  o AS (SELECT *, length(bin((x >> 2) + 8)) - 4 AS k FROM x),
  i AS (SELECT *, k * 8 + ((((x >> 2) + 8) >> k::INT) & 7) AS i FROM o),
  a AS (SELECT *, ((x - xs[i + 1]) << 10) >> (k + 2)::INT AS a FROM i)
  SELECT vec_id, (((((rs[i + 1] * (1024 - a) + rs[i + 2] * a) >> 10) << 6) + 1) >> 1)::BIGINT AS rate, ((v * ((ds[i + 1] * (1024 - a) + ds[i + 2] * a) >> 10) + 512) >> 10)::BIGINT AS distortion FROM a""")
def laplacian_model(spark, d):
    node = _blocks(spark, d).select("vec_id", B.node_sums(F.col("b"), 8)[0].alias("x"))
    v = node.select("vec_id", (F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6)).alias("v")).filter("v > 0")
    rate, distortion = M.model_rate_distortion(F.col("v"), 6, F.col("vec_id") % 40 + 8)
    return v.select("vec_id", rate.alias("rate"), distortion.alias("distortion"))


CURVE = [round(40 / (1 + 0.3 * k) ** 2, 6) for k in range(18)]


@oracle(f"""
  WITH p AS (SELECT p_brand, least(greatest(ln(1 + p_retailprice) * 1.7e0, 1), 15.5e0) AS x, {[float(x) for x in CURVE]}::DOUBLE[] AS t FROM part),
  i AS (SELECT *, floor(x)::INT AS i, x - floor(x) AS f FROM p),
  q AS (SELECT p_brand, f, t[i] AS p0, t[i + 1] AS p1, t[i + 2] AS p2, t[i + 3] AS p3 FROM i)
  SELECT p_brand, round(sum(p1 + 0.5e0 * f * (p2 - p0 + f * (2.0e0 * p0 - 5.0e0 * p1 + 4.0e0 * p2 - p3 + f * (3.0e0 * (p1 - p2) + p3 - p0)))), 4) AS rate FROM q GROUP BY 1""")
def curve_fit_model(spark, d):
    x = F.least(F.greatest(F.log(F.col("p_retailprice") + 1) * 1.7, F.lit(1.0)), F.lit(15.5))
    rows = load(spark, d, "part").select("p_brand", x.alias("x"))
    return rows.groupBy("p_brand").agg(F.round(F.sum(M.cubic(CURVE, F.col("x"))), 4).alias("rate"))


@oracle(f"""
  WITH t AS (SELECT * FROM (VALUES {', '.join(map(str, M.DERIVATIVES.items()))}) AS t(a, x)), p AS (SELECT p_partkey, [45, 67, 113, 135, 157, 203, 90, 180][p_partkey % 8 + 1] + (p_size % 7 - 3) * 3 AS angle FROM part)
  SELECT angle, CASE WHEN angle < 90 THEN a.x WHEN angle > 90 AND angle < 180 THEN b.x ELSE 1 END AS dx, CASE WHEN angle > 90 AND angle < 180 THEN c.x WHEN angle > 180 THEN e.x ELSE 1 END AS dy, count(*) AS n
  FROM p LEFT JOIN t a ON a.a = angle LEFT JOIN t b ON b.a = 180 - angle LEFT JOIN t c ON c.a = angle - 90 LEFT JOIN t e ON e.a = 270 - angle GROUP BY ALL""")
def angle_derivatives(spark, d):
    angle = F.array(*map(F.lit, [45, 67, 113, 135, 157, 203, 90, 180]))[(F.col("p_partkey") % 8).cast("int")] + (F.col("p_size") % 7 - 3) * 3
    rows = load(spark, d, "part").groupBy(angle.alias("angle")).agg(F.count("*").alias("n"))
    dx, dy = M.angle_derivatives(F.col("angle"))
    return rows.select("angle", dx.alias("dx"), dy.alias("dy"), "n")


@oracle("""
  WITH v AS (SELECT l_partkey % 401 - 200 AS r, CASE WHEN l_linenumber < 3 THEN 0 ELSE l_orderkey % 2001 - 1000 END AS c FROM lineitem), z AS (SELECT *, abs(r) - 1 AS zr, abs(c) - 1 AS zc FROM v)
  SELECT (r <> 0)::INT * 2 + (c <> 0)::INT AS joint, CASE WHEN r <> 0 THEN CASE WHEN zr < 16 THEN 0 ELSE least(length(bin(greatest(zr >> 3, 1))) - 1, 10) END END::INTEGER AS class_r,
    CASE WHEN c <> 0 THEN CASE WHEN zc < 16 THEN 0 ELSE least(length(bin(greatest(zc >> 3, 1))) - 1, 10) END END::INTEGER AS class_c, count(*) AS n FROM z GROUP BY ALL""")
def vector_classes(spark, d):
    r, c = F.col("l_partkey") % 401 - 200, F.when(F.col("l_linenumber") < 3, 0).otherwise(F.col("l_orderkey") % 2001 - 1000)
    keys = (M.vector_joint(r, c).alias("joint"), M.vector_class(r).cast("int").alias("class_r"), M.vector_class(c).cast("int").alias("class_c"))
    return load(spark, d, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"))


@oracle("""
  WITH w AS (SELECT 200 + p_size * 37 AS w, 8 + p_partkey % 9 AS den FROM part), k AS (SELECT w, den, CASE WHEN den <= 8 THEN w ELSE (w * 8 + den // 2) // den END AS coded FROM w)
  SELECT w AS width, den::BIGINT AS denominator, coded::BIGINT AS coded, ((coded << 14) + w // 2) // w AS step, count(*) AS n FROM k GROUP BY ALL""")
def superres_sizes(spark, d):
    rows = load(spark, d, "part").select((F.col("p_size") * 37 + 200).alias("width"), (F.col("p_partkey") % 9 + 8).alias("denominator"))
    rows = rows.groupBy("width", "denominator").agg(F.count("*").alias("n"))
    rows = rows.withColumn("coded", M.coded_width(F.col("width"), F.col("denominator")).cast("bigint"))
    return rows.withColumn("step", M.upscale_step(F.col("coded"), F.col("width")))


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (M.CASTAGNOLI if x & 1 else 0) for x in table]
    return table


@oracle(f"""
  WITH t AS (SELECT {_crc_table()}::BIGINT[] AS t), b AS (SELECT p_partkey, list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(p_name, '')]) AS b FROM part)
  SELECT p_partkey, xor(list_reduce(b, lambda crc, x: xor(crc >> 8, t[(xor(crc, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM b, t""")
def crc32c_names(spark, d):
    return load(spark, d, "part").select("p_partkey", M.crc32c(F.col("p_name").cast("binary")).alias("crc"))


@oracle("""
  WITH g AS (SELECT o_orderkey, o_orderkey * 700001 AS x FROM orders) SELECT o_orderkey, CASE WHEN x <= 4294967295 THEN x END AS value FROM g""")
def leb128_decode(spark, d):
    """Numbers coded in groups of seven bits and read back; those above 32 bits are none."""
    x = F.col("o_orderkey") * 700_001
    part = lambda i: F.shiftright(x, 7 * i).bitwiseAND(127)
    groups = [F.when((F.lit(i) == 0) | (F.shiftright(x, 7 * i) > 0), F.lpad(F.hex(part(i) + F.when(F.shiftright(x, 7 * (i + 1)) > 0, 128).otherwise(0)), 2, "0")) for i in range(9)]
    return load(spark, d, "orders").select("o_orderkey", M.leb128_value(F.concat_ws("", *groups)).alias("value"))


@oracle("""
  WITH m AS (SELECT level, plane, size, 32 + (15 - level) * (2 + plane) + size * 4 AS weight FROM range(16) AS a(level), range(2) AS b(plane), range(4) AS c(size))
  SELECT p_brand, count(*) AS n, sum(weight)::BIGINT AS weight FROM part JOIN m ON level = p_size % 16 AND plane = p_partkey % 2 AND size = p_partkey % 5 GROUP BY 1""")
def quant_matrix_join(spark, d):
    matrices = spark.range(16 * 2 * 4).select(F.expr("id div 8").alias("level"), F.expr("id div 4 % 2").alias("plane"), (F.col("id") % 4).alias("size"))
    matrices = matrices.withColumn("weight", F.expr("32 + (15 - level) * (2 + plane) + size * 4"))
    parts = load(spark, d, "part").select("p_brand", (F.col("p_size") % 16).cast("bigint").alias("level"), (F.col("p_partkey") % 2).alias("plane"), (F.col("p_partkey") % 5).alias("size"))
    return parts.join(F.broadcast(matrices), ["level", "plane", "size"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@oracle("""
  WITH c AS (SELECT mode, context, 512 + (mode * 37 + context * 101) % 700 AS cost FROM range(13) AS a(mode), range(5) AS b(context))
  SELECT l_returnflag, l_linestatus, count(*) AS n, sum(coalesce(cost, 5000))::BIGINT AS cost FROM lineitem LEFT JOIN c ON mode = l_partkey % 14 AND context = l_suppkey % 5 GROUP BY ALL""")
def mode_costs(spark, d):
    table = spark.range(13 * 5).select(F.expr("id div 5").alias("mode"), (F.col("id") % 5).alias("context"))
    table = table.withColumn("cost", F.expr("512 + (mode * 37 + context * 101) % 700"))
    items = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_partkey") % 14).alias("mode"), (F.col("l_suppkey") % 5).alias("context")).agg(F.count("*").alias("n"))
    cost = F.coalesce("cost", F.lit(5000)) * F.col("n")
    return items.join(F.broadcast(table), ["mode", "context"], "left").groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.sum(cost).alias("cost"))


# ---- folds and fits ----


@oracle("""
  SELECT l_suppkey, CASE WHEN bool_or(l_discount >= 0.0999 AND l_quantity > 49) THEN 2147483647 ELSE least(sum(l_partkey), 2147483647) END::BIGINT AS rate, sum(l_orderkey)::BIGINT AS dist, bool_and(l_tax < 0.0799) AS skip
  FROM lineitem GROUP BY 1""")
def merged_stats(spark, d):
    rate = F.when((F.col("l_discount") >= 0.0999) & (F.col("l_quantity") > 49), 2**31 - 1).otherwise(F.col("l_partkey"))
    items = load(spark, d, "lineitem").select("l_suppkey", rate.alias("r"), "l_orderkey", (F.col("l_tax") < 0.0799).alias("s"))
    return G.merged_stats(items, ["l_suppkey"], "r", "l_orderkey", "s")


@oracle("""
  WITH s AS (SELECT *, abs(l_partkey % 400 - l_suppkey % 400) AS dist, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS m FROM s WHERE dist <= 120 OR k = 1)
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (dist > 120) AS n_far FROM n WHERE m <= 4 GROUP BY 1""")
def sample_selection(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = load(spark, d, "lineitem").select("l_orderkey", order.alias("o"), F.abs(F.col("l_partkey") % 400 - F.col("l_suppkey") % 400).alias("dist"))
    return G.selected_samples(items, "l_orderkey", "o", F.col("dist"), F.lit(120), 4)


@oracle(f"""
  WITH {EVENTS}, m AS (SELECT *, v - 800 AS x FROM e),
  p AS ({' UNION ALL '.join(f'SELECT user_id, {k} AS lag, x * lag(x, {k}) OVER (PARTITION BY user_id, day ORDER BY event_id) AS xy FROM m' for k in range(3))}),
  r AS (SELECT user_id, sum(xy) FILTER (lag = 0)::DOUBLE AS r0, sum(xy) FILTER (lag = 1)::DOUBLE AS r1, sum(xy) FILTER (lag = 2)::DOUBLE AS r2 FROM p WHERE xy IS NOT NULL GROUP BY 1)
  SELECT user_id, round(r1 * (r0 - r2) / (r0 * r0 - r1 * r1), 6) + 0.0 AS a1, round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 6) + 0.0 AS a2,
    round(r0 - r1 * (r0 - r2) / (r0 * r0 - r1 * r1) * r1 - (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) * r2, 0) AS gain FROM r""")
def noise_model_fit(spark, d):
    """A second-order autoregression of each user's values: products at lags summed up, the normal equations solved."""
    rows = _events(spark, d).withColumn("x", F.col("v") - 800)
    sums = S.lag_products(rows, ["user_id", "day"], "event_id", "x", 3)
    r = sums.groupBy("user_id").agg(*(F.sum(F.when(F.col("lag") == k, F.col("xy"))).cast("double").alias(f"r{k}") for k in range(3)))
    det = F.expr("r0 * r0 - r1 * r1")
    a1, a2 = F.expr("r1 * (r0 - r2)") / det, F.expr("r0 * r2 - r1 * r1") / det
    return r.select("user_id", (F.round(a1, 6) + 0.0).alias("a1"), (F.round(a2, 6) + 0.0).alias("a2"), F.round(F.col("r0") - a1 * F.col("r1") - a2 * F.col("r2"), 0).alias("gain"))


@oracle(f"""
  WITH x AS (SELECT least(greatest(CAST(l_quantity AS BIGINT) - 1, 0), 49) AS p, floor(l_discount * 100 + 0.5)::BIGINT AS s FROM lineitem),
  i AS (SELECT least(p // 7, 6) AS bin, p - least(p // 7, 6) * 7 AS a, s FROM x),
  m AS (SELECT bin, sum((7 - a) * (7 - a))::DOUBLE AS m00, sum((7 - a) * a)::DOUBLE AS m01, sum(a * a)::DOUBLE AS m11, sum((7 - a) * s)::DOUBLE AS b0, sum(a * s)::DOUBLE AS b1 FROM i GROUP BY 1)
  SELECT bin, round((b0 * m11 - b1 * m01) / (m00 * m11 - m01 * m01) * 7, 5) + 0.0 AS low, round((b1 * m00 - b0 * m01) / (m00 * m11 - m01 * m01) * 7, 5) + 0.0 AS high FROM m""")
def noise_strength_solved(spark, d):
    """Each bin's own line through its samples: the normal equations of ``strength_bins``, solved."""
    q = F.col("l_quantity").cast("bigint") - 1
    sums = S.strength_bins(load(spark, d, "lineitem"), q, F.floor(F.col("l_discount") * 100 + 0.5), 0, 7, 8)
    m = sums.select("bin", *(F.col(c).cast("double").alias(c) for c in ("m00", "m01", "m11", "b0", "b1")))
    det = F.expr("m00 * m11 - m01 * m01")
    return m.select("bin", (F.round(F.expr("b0 * m11 - b1 * m01") / det * 7, 5) + 0.0).alias("low"), (F.round(F.expr("b1 * m00 - b0 * m01") / det * 7, 5) + 0.0).alias("high"))


@oracle(f"""
  WITH {CELLS}, v AS (SELECT vec_id, label, (sum(v * v) - ((sum(v)::BIGINT * sum(v)::BIGINT) >> 6))::BIGINT AS v FROM cells GROUP BY ALL),
  t AS (SELECT quantile_disc(v, 0.9) AS t FROM v) SELECT label, count(*) FILTER (v >= t) AS n_flat, max(t) AS threshold FROM v, t GROUP BY 1""")
def flat_percentile(spark, d):
    """Blocks from the score's 90th percentile on, which is found by descent over histograms of the score's digits."""
    node = _blocks(spark, d).select("label", B.node_sums(F.col("b"), 8)[0].alias("x"))
    v = node.select("label", (F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6)).alias("v"))
    threshold = E.exact_quantile(v, F.col("v"), 0.9)
    at = F.lit(threshold).cast("bigint")
    return v.groupBy("label").agg(F.count_if(F.col("v") >= at).alias("n_flat")).withColumn("threshold", at)


@oracle(f"WITH {CELLS} SELECT label, min(v) AS low, max(v) AS high, count(*) AS n FROM cells GROUP BY 1")
def value_bounds(spark, d):
    one = _blocks(spark, d).select("label", F.array_min("b").alias("low"), F.array_max("b").alias("high"), F.size("b").alias("n"))
    return one.groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


@oracle(f"""
  WITH {EVENTS}, h AS (SELECT day, hour(ts) AS hour, sum(v)::BIGINT AS v FROM e GROUP BY ALL), s AS (SELECT day, list(v ORDER BY hour) AS s FROM h GROUP BY 1),
  p AS (SELECT day, s, unnest(range((len(s) * 5 + 2) // 3)) AS pos FROM s), q AS (SELECT day, pos, s, pos * 768 // 5 AS place FROM p)
  SELECT day, pos, (s[least(place >> 8, len(s) - 1) + 1] * (256 - (place & 255)) + s[least((place >> 8) + 1, len(s) - 1) + 1] * (place & 255) + 128) >> 8 AS value FROM q""")
def resized_series(spark, d):
    hours = _events(spark, d).groupBy("day", F.hour("ts").alias("hour")).agg(F.sum("v").alias("v"))
    series = hours.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("hour", "v"))), lambda x: x["v"]).alias("s"))
    return series.select("day", F.posexplode(X.resampled(F.col("s"), 3, 5)).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


# ---- filters ----

WIENER = [3, -7, 15]


def separable_sql(taps: dict[int, int], shifts: tuple[int, int], bounds: tuple[tuple[int, int], tuple[int, int]]) -> str:
    k = f"k AS (SELECT * FROM (VALUES {', '.join(map(str, taps.items()))}) AS t(d, w))"
    one = lambda name, given, same, along, i: f"{name} AS (SELECT a.vec_id, a.r, a.c, {sql_clamp(f'(sum(b.v * w)::BIGINT + {1 << shifts[i] - 1}) >> {shifts[i]}', *bounds[i])} AS v FROM {given} a, k, {given} b WHERE b.vec_id = a.vec_id AND b.{same} = a.{same} AND b.{along} = {sql_clamp(f'a.{along} + d', 0, 7)} GROUP BY ALL)"
    return f"{k}, {one('h', 'cells', 'r', 'c', 0)}, {one('f', 'h', 'c', 'r', 1)}"


@oracle(f"""
  WITH {CELLS}, {separable_sql({-3: 3, -2: -7, -1: 15, 0: 106, 1: 15, 2: -7, 3: 3}, (3, 11), ((-256 << 4, 255 << 4), (-256, 255)))}
  SELECT vec_id, sum(v)::BIGINT AS total, min(v) AS low, max(v) AS high, max(v) FILTER (r = 0 AND c = 7) AS corner FROM f GROUP BY 1""")
def wiener_filter(spark, d):
    b = X.symmetric_filter("b", _blocks(spark, d), WIENER, 7, 3, -256, 255)
    return b.select("vec_id", B.total(F.col("b")).alias("total"), F.array_min("b").alias("low"), F.array_max("b").alias("high"), F.col("b")[7].alias("corner"))


def along(direction: int) -> str:
    steps = [(s * r, s * c, tap) for (r, c), tap in zip(X.DIRECTION_STEPS[direction], (4, 2), strict=True) for s in (1, -1)]
    return ", ".join(map(str, steps))


@oracle(f"""
  WITH {CELLS}, k AS (SELECT * FROM (VALUES {along(3)}) AS t(dr, dc, w)),
  s AS (SELECT a.vec_id, a.r, a.c, a.v, sum(w * sign(b.v - a.v) * least(abs(b.v - a.v), greatest(0, 40 - (abs(b.v - a.v) >> 2))))::BIGINT AS s
    FROM cells a, k, cells b WHERE b.vec_id = a.vec_id AND b.r = (CASE WHEN a.r + dr BETWEEN 0 AND 7 AND a.c + dc BETWEEN 0 AND 7 THEN a.r + dr ELSE a.r END)
      AND b.c = (CASE WHEN a.r + dr BETWEEN 0 AND 7 AND a.c + dc BETWEEN 0 AND 7 THEN a.c + dc ELSE a.c END) GROUP BY ALL)
  SELECT vec_id, sum(v + ((s + 8 - (s < 0)::INT) >> 4))::BIGINT AS total, sum(abs((s + 8 - (s < 0)::INT) >> 4))::BIGINT AS moved FROM s GROUP BY 1""")
def directional_filter(spark, d):
    given = _blocks(spark, d).withColumn("given", F.col("b"))
    b = X.directional_filter(given, 3, 40, 7)
    return b.select("vec_id", B.total(F.col("b")).alias("total"), B.total(F.zip_with("b", "given", lambda x, y: F.abs(x - y))).alias("moved"))


@oracle(f"""
  WITH {CELLS}, k AS (SELECT * FROM (VALUES (1, -1, 4), (1, 0, 8), (1, 1, 4), (2, -1, 5), (2, 0, 6), (2, 1, 5), (3, -2, 2), (3, -1, 4), (3, 0, 4), (3, 1, 4), (3, 2, 2)) AS t(s, d, w)),
  e AS (SELECT vec_id, c, v FROM cells WHERE r = 0),
  f AS (SELECT a.vec_id, s, a.c, CASE WHEN a.c = 0 THEN any_value(a.v) ELSE (sum(b.v * w)::BIGINT + 8) >> 4 END AS v FROM e a, k, e b WHERE b.vec_id = a.vec_id AND b.c = {sql_clamp('a.c + d', 0, 7)} GROUP BY a.vec_id, s, a.c)
  SELECT vec_id, s::INTEGER AS strength, sum(v * (c + 1))::BIGINT AS weighted FROM f GROUP BY ALL""")
def filtered_edges(spark, d):
    top = F.slice("b", 1, 8)
    forms = F.array(*(F.struct(F.lit(s).alias("strength"), X.filtered_edge(top, s).alias("e")) for s in (1, 2, 3)))
    rows = _blocks(spark, d).select("vec_id", F.explode(forms).alias("x"))
    return rows.select("vec_id", "x.strength", B.total(F.transform("x.e", lambda v, i: v * (i + 1))).alias("weighted"))


@oracle(f"""
  WITH {CELLS}, e AS (SELECT vec_id, list(v ORDER BY c) AS e FROM cells WHERE r = 0 GROUP BY 1), i AS (SELECT vec_id, e, unnest(range(8)) AS i FROM e)
  SELECT vec_id, sum(e[i + 1])::BIGINT AS same, sum({sql_clamp('(9 * e[greatest(i - 1, 0) + 1] + 9 * e[i + 1] - e[greatest(i - 2, 0) + 1] - e[least(i + 1, 7) + 1] + 8) >> 4', -400, 400)})::BIGINT AS half FROM i GROUP BY 1""")
def doubled_edges(spark, d):
    rows = _blocks(spark, d).select("vec_id", X.doubled_edge(F.slice("b", 1, 8), -400, 400).alias("e"))
    part = lambda odd: B.total(F.filter("e", lambda _, i: i % 2 == odd))
    return rows.select("vec_id", part(1).alias("same"), part(0).alias("half"))


# ---- transforms and choices ----


def lifted_sql(name: str, given: str, keep: str, over: str, place: str, factor: int) -> str:
    """SQL: four samples of ``given`` along ``over`` to four of ``name``."""
    pick = ", ".join(f"max(v) FILTER ({over} = {i}) AS s{i}" for i in range(4))
    return (
        f"{name}0 AS (SELECT vec_id, q, {keep}, {pick} FROM {given} GROUP BY ALL), {name}1 AS (SELECT *, s0 + s1 AS lo, s3 - s2 AS hi FROM {name}0), {name}2 AS (SELECT *, (lo - hi) >> 1 AS half FROM {name}1), "
        f"{name} AS (SELECT vec_id, q, {keep}, unnest([0, 1, 2, 3]) AS {place}, unnest([lo - (half - s2), half - s2, hi + (half - s1), half - s1]) * {factor} AS v FROM {name}2)"
    )


WHT = f"""{CELLS}, quarter AS (SELECT vec_id, r // 4 * 2 + c // 4 AS q, r % 4 AS r, c % 4 AS c, v FROM cells),
  {lifted_sql('x', 'quarter', 'c', 'r', 'k', 1)}, y AS (SELECT vec_id, q, c AS i, k AS j, v FROM x), {lifted_sql('z', 'y', 'j', 'i', 'k', 4)}"""


@oracle(f"""
  WITH {WHT} SELECT vec_id, q::INTEGER AS quarter, sum(v * (k * 4 + j + 1))::BIGINT AS weighted, sum(abs(v))::BIGINT AS size FROM z GROUP BY ALL""")
def walsh_hadamard(spark, d):
    rows = _blocks(spark, d).select("vec_id", F.posexplode(X.quarters(F.col("b"))).alias("quarter", "q"))
    rows = rows.select("vec_id", "quarter", F.array(*X.walsh_hadamard_4x4([F.col("q")[i] for i in range(16)])).alias("t"))
    return rows.select("vec_id", "quarter", B.total(F.transform("t", lambda v, i: v * (i + 1))).alias("weighted"), B.total(F.transform("t", F.abs)).alias("size"))


@oracle(f"""
  WITH {WHT}, m AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {x})' for i, row in enumerate(B.HADAMARD) for j, x in enumerate(row))}) AS t(k, j, w)),
  h AS (SELECT vec_id, r, m.k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL), t AS (SELECT vec_id, m.k AS kr, h.k AS kc, sum(x * w) AS x FROM h JOIN m ON r = j GROUP BY ALL),
  one AS (SELECT vec_id, sum(abs(x))::BIGINT >> 2 AS whole FROM t GROUP BY 1), four AS (SELECT vec_id, (sum(abs(v))::BIGINT >> 2) + 400 AS parts FROM z GROUP BY 1)
  SELECT vec_id, least(whole, parts) AS cost, parts < whole AS in_quarters FROM one JOIN four USING (vec_id)""")
def transform_size_argmin(spark, d):
    rows = B.transformed(_blocks(spark, d), B.HADAMARD, "bigint")
    whole = F.shiftright(B.total(F.transform("t", F.abs)), 2)
    size = lambda q: B.total(F.transform(F.array(*X.walsh_hadamard_4x4([q[i] for i in range(16)])), F.abs))
    parts = F.shiftright(B.total(F.transform(X.quarters(F.col("b")), size)), 2) + 400
    return rows.select("vec_id", whole.alias("whole"), parts.alias("parts")).select("vec_id", F.least("whole", "parts").alias("cost"), (F.col("parts") < F.col("whole")).alias("in_quarters"))


@oracle(f"""
  WITH {PAIRS}, m AS (SELECT vec_id, (sum(v)::BIGINT + 32) >> 6 AS m FROM cells GROUP BY 1),
  x AS (SELECT p.vec_id, alpha, sum((b.v - mb.m - (((a.v - ma.m) * alpha + 4) >> 3)) * (b.v - mb.m - (((a.v - ma.m) * alpha + 4) >> 3)))::BIGINT AS sse
    FROM p, range(-4, 5) AS t(alpha), cells a, cells b, m ma, m mb WHERE a.vec_id = p.vec_id AND b.vec_id = other_id AND a.i = b.i AND ma.vec_id = p.vec_id AND mb.vec_id = other_id GROUP BY ALL)
  SELECT vec_id, min(sse) AS sse, arg_min(alpha, (sse, abs(alpha), alpha))::INTEGER AS alpha FROM x GROUP BY 1""")
def chroma_argmin(spark, d):
    return _pairs(spark, d).select("vec_id", X.chroma_from_luma(F.col("b"), F.col("other"), range(-4, 5)).alias("x")).select("vec_id", "x.sse", "x.alpha")


@oracle(f"""
  WITH {CELLS}, l AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1), s AS (SELECT vec_id, n, lo + (hi - lo) * (2 * i + 1) // (2 * n) AS colour FROM l, range(2, 9) AS a(n), range(8) AS b(i) WHERE i < n),
  e AS (SELECT vec_id, n, cells.i, min((v - colour) * (v - colour)) AS e FROM cells JOIN s USING (vec_id) GROUP BY ALL), k AS (SELECT vec_id, n, sum(e)::BIGINT + n * 3000 AS cost FROM e GROUP BY vec_id, n)
  SELECT vec_id, min(cost) AS cost, arg_min(n, (cost, n))::INTEGER AS n FROM k GROUP BY 1""")
def palette_size_argmin(spark, d):
    return _blocks(spark, d).select("vec_id", X.palette_size(F.col("b"), range(2, 9), 3000).alias("x")).select("vec_id", "x.cost", "x.n")


@oracle(f"""
  WITH {CELLS}, l AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1), s AS (SELECT vec_id, k, lo + (hi - lo) * (2 * k + 1) // 8 AS colour FROM l, range(4) AS b(k)),
  m AS (SELECT vec_id, i, arg_min(k, (abs(v - colour), k)) AS k FROM cells JOIN s USING (vec_id) GROUP BY vec_id, i)
  SELECT vec_id, sum(colour)::BIGINT AS total, sum(k * (i + 1))::BIGINT AS map FROM m JOIN s USING (vec_id, k) GROUP BY 1""")
def palette_applied(spark, d):
    rows = _blocks(spark, d).withColumn("p", X.palette_of(F.col("b"), F.lit(4)))
    nearest = F.transform("b", lambda x: F.array_min(F.transform("p", lambda c, k: F.struct(F.abs(x - c).alias("d"), k.alias("k"))))["k"])
    rows = rows.withColumn("k", nearest)
    return rows.select("vec_id", B.total(F.transform("k", lambda k: F.get("p", k))).alias("total"), B.total(F.transform("k", lambda k, i: k * (i + 1))).alias("map"))


@oracle(f"""
  WITH {PAIRS}, e AS (SELECT vec_id, list(v ORDER BY c) AS e FROM cells WHERE r = 0 GROUP BY 1),
  a AS (SELECT p.vec_id, other_id, e FROM p JOIN e ON e.vec_id = other_id),
  x AS (SELECT a.vec_id, dx, v, (((r + 1) * dx) >> 6) + c AS i, (((r + 1) * dx) & 63) >> 1 AS s, e FROM a JOIN cells USING (vec_id), (VALUES (64), (27), (102)) AS t(dx)),
  k AS (SELECT vec_id, dx, sum(abs(v - ((e[least(i, 7) + 1] * (32 - s) + e[least(i + 1, 7) + 1] * s + 16) >> 5)))::BIGINT AS sad FROM x GROUP BY ALL)
  SELECT vec_id, min(sad) AS sad, arg_min(dx, (sad, dx))::INTEGER AS dx FROM k GROUP BY 1""")
def directional_argmin(spark, d):
    above = F.slice("other", 1, 8)
    sad = lambda dx: B.total(F.zip_with("b", X.directional_prediction(above, dx), lambda x, y: F.abs(x - y)))
    best = F.array_min(F.array(*(F.struct(sad(dx).alias("sad"), F.lit(dx).alias("dx")) for dx in (27, 64, 102))))
    return _pairs(spark, d).select("vec_id", best.alias("x")).select("vec_id", "x.sad", "x.dx")


@oracle(f"""
  WITH {PAIRS}, w AS (SELECT vec_id, r, c, v, sum(v) OVER (PARTITION BY vec_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM cells),
  x AS (SELECT p.vec_id, l, sum((b.v - ((a.v * 24 + (a.s - 3 * a.v) * l + 12) // 24)) * (b.v - ((a.v * 24 + (a.s - 3 * a.v) * l + 12) // 24)))::BIGINT AS sse
    FROM p, range(5) AS t(l), w a, cells b WHERE a.vec_id = p.vec_id AND b.vec_id = other_id AND a.r = b.r AND a.c = b.c AND a.c BETWEEN 1 AND 6 GROUP BY ALL)
  SELECT vec_id, min(sse) AS sse, arg_min(l, (sse, l))::INTEGER AS level FROM x GROUP BY 1""")
def filter_level_search(spark, d):
    """The strength of a smoothing along rows that brings a block nearest to another one."""
    pairs = _pairs(spark, d)
    three = B.added([B.shifted("b", 0, k, False) for k in (-1, 0, 1)])
    inner = F.array(*(F.lit(r * 8 + c) for r in range(8) for c in range(1, 7)))
    pairs = pairs.select("vec_id", F.transform(inner, lambda i: F.get("b", i)).alias("x"), F.transform(inner, lambda i: F.get(three, i)).alias("s"), F.transform(inner, lambda i: F.get("other", i)).alias("y"))
    moved = lambda level: F.zip_with("x", "s", lambda x, s: F.call_function("div", x * 24 + (s - x * 3) * level + 12, F.lit(24)))
    sse = lambda level: B.total(F.zip_with(moved(level), "y", lambda p, y: (y - p) * (y - p)))
    best = F.array_min(F.array(*(F.struct(sse(level).alias("sse"), F.lit(level).alias("level")) for level in range(5))))
    return pairs.select("vec_id", best.alias("x")).select("vec_id", "x.sse", "x.level")


@oracle(f"""
  WITH {PAIRS} SELECT p.vec_id, ((sum(d * d) - ((sum(d)::BIGINT * sum(d)::BIGINT) >> 3)))::BIGINT AS variance
  FROM p, (SELECT a.vec_id AS x, b.vec_id AS y, a.c, (sum(a.v)::BIGINT >> 1) - (sum(b.v)::BIGINT >> 1) AS d FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i GROUP BY ALL)
  WHERE x = p.vec_id GROUP BY 1""")
def projection_variance(spark, d):
    return _pairs(spark, d).select("vec_id", X.vector_variance(X.projected(F.col("b")), X.projected(F.col("other")), 3).alias("variance"))


@oracle(f"""
  WITH {CELLS}, m AS (SELECT k, j, w::DOUBLE AS w FROM (VALUES {', '.join(f'({i}, {j}, {x!r}e0)' for i, row in enumerate(B.DCT) for j, x in enumerate(row))}) AS t(k, j, w)),
  t AS (SELECT vec_id, r, k, sum(v * w) AS x FROM cells JOIN m ON c = j GROUP BY ALL), s AS (SELECT vec_id, r, k, CASE WHEN x * x > 900.5e0 THEN x * (1 - 900.5e0 / (x * x)) ELSE 0 END AS x FROM t),
  i AS (SELECT vec_id, r, j AS c, sum(x * w) AS x FROM s JOIN m USING (k) GROUP BY ALL)
  SELECT vec_id, round(sum(abs(cells.v - x)), 3) AS moved, round(max(x), 3) AS most FROM i JOIN cells USING (vec_id, r, c) GROUP BY 1""")
def wiener_denoise(spark, d):
    """Each row's coefficients, less the share that is noise of a known power, and back."""
    there = B.transformed(_blocks(spark, d), B.DCT, "double", rows_too=False).withColumnRenamed("b", "given")
    shrunk = there.withColumn("b", F.transform("t", lambda x: F.when(x * x > 900.5, x * (F.lit(1.0) - F.lit(900.5) / (x * x))).otherwise(0.0)))
    back = B.transformed(shrunk, [list(x) for x in zip(*B.DCT, strict=True)], "double", rows_too=False)
    return back.select("vec_id", F.round(B.total(F.zip_with("given", "t", lambda x, y: F.abs(x - y)), "double"), 3).alias("moved"), F.round(F.array_max("t"), 3).alias("most"))


@oracle(f"""
  WITH {CELLS}, w AS (
    SELECT *, lead(v) OVER (PARTITION BY vec_id, r ORDER BY c) - lag(v) OVER (PARTITION BY vec_id, r ORDER BY c) AS dx, lead(v) OVER (PARTITION BY vec_id, c ORDER BY r) - lag(v) OVER (PARTITION BY vec_id, c ORDER BY r) AS dy FROM cells),
  g AS (SELECT * FROM w WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6),
  b AS (SELECT label, {sql_clamp('dy * 4 // dx + 4', 0, 7)} AS bin, abs(dx) + abs(dy) AS w FROM g WHERE dx <> 0 UNION ALL SELECT label, o, (abs(dx) + abs(dy)) // 2 FROM g, (VALUES (0), (7)) AS t(o) WHERE dx = 0),
  h AS (SELECT label, bin, sum(w)::BIGINT AS w FROM b GROUP BY ALL), s AS (SELECT label, bin, w, sum(w) OVER (PARTITION BY label)::BIGINT AS all_w FROM h)
  SELECT label, count(*) AS n_bins, count(*) FILTER (w * 1000 < all_w * 110) AS n_pruned, sum((1 << bin::INT)) FILTER (w * 1000 >= all_w * 110)::BIGINT AS kept FROM s GROUP BY 1""")
def orientation_prune(spark, d):
    """Directions whose share of the orientation histogram is too small are not tried."""
    h = B.gradient_histogram(_blocks(spark, d))
    h = h.withColumn("all_w", F.sum("total").over(Window.partitionBy("label")))
    small = F.col("total") * 1000 < F.col("all_w") * 110
    kept = F.sum(F.when(~small, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bin").cast("int"))))
    return h.groupBy("label").agg(F.count("*").alias("n_bins"), F.count_if(small).alias("n_pruned"), kept.alias("kept"))


@oracle(f"""
  WITH {PAIRS}, m AS (SELECT k, j, w::DOUBLE AS w FROM (VALUES {', '.join(f'({i}, {j}, {x!r}e0)' for i, row in enumerate(B.DCT) for j, x in enumerate(row))}) AS t(k, j, w)),
  d AS (SELECT p.vec_id, a.r, a.c, a.v, b.v AS base, a.v - b.v AS d FROM p JOIN cells a ON a.vec_id = p.vec_id JOIN cells b ON b.vec_id = other_id AND a.i = b.i),
  h AS (SELECT vec_id, r, k, sum(d * w) AS x FROM d JOIN m ON c = j GROUP BY ALL), t AS (SELECT vec_id, m.k AS kr, h.k AS kc, floor(sum(x * w) / 61.803398875e0 + 0.5) AS level FROM h JOIN m ON r = j GROUP BY ALL),
  g AS (SELECT vec_id, kr, j AS c, sum(level * 61.803398875e0 * w) AS x FROM t JOIN m ON kc = k GROUP BY ALL), i AS (SELECT vec_id, j AS r, g.c, floor(sum(x * w) + 0.5)::BIGINT AS x FROM g JOIN m ON kr = k GROUP BY ALL),
  o AS (SELECT vec_id, v, {sql_clamp('base + x', -450, 450)} AS y FROM i JOIN d USING (vec_id, r, c))
  SELECT vec_id, sum((v - y) * (v - y))::BIGINT AS sse, min(y) AS low, max(y) AS high FROM o GROUP BY 1""")
def reconstructed_pairs(spark, d):
    """A block from another one: their difference transformed, quantised, and back, added and clipped."""
    step = 61.803398875
    rows = _pairs(spark, d).withColumnsRenamed({"b": "given"}).withColumn("b", F.zip_with("given", "other", lambda x, y: x - y))
    levels = B.transformed(rows, B.DCT, "double").withColumn("b", F.transform("t", lambda x: F.floor(x / step + 0.5).cast("double") * step))
    back = B.transformed(levels, [list(x) for x in zip(*B.DCT, strict=True)], "double")
    y = F.zip_with("other", "t", lambda p, x: clamp(p + F.floor(x + 0.5), -450, 450))
    return back.withColumn("y", y).select("vec_id", B.total(F.zip_with("given", "y", lambda x, z: (x - z) * (x - z))).alias("sse"), F.array_min("y").alias("low"), F.array_max("y").alias("high"))
