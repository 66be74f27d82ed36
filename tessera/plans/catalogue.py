"""Queries over the tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import clamp, div, leb128_size, round_shift
from ..operators import blocks as B
from ..operators import histograms as H
from ..operators import lookups as L
from ..operators import sequences as S
from ..sources.tables import blocks, load
from ..streaming.slots import slot_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The event types, in the order of their symbols.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def quantity() -> F.Column:
    return F.col("l_quantity").cast("bigint")


def _blocks(spark, d) -> DataFrame:
    return blocks(load(spark, d, "embeddings"))


def _events(spark, d) -> DataFrame:
    return load(spark, d, "events").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "v": F.floor(F.col("value") * 16)})


# ---- histograms ----


@query
def top_values_per_brand(spark, d):
    items = load(spark, d, "lineitem").select("l_partkey", quantity().alias("q"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return H.top_values(items.join(parts, "l_partkey"), F.col("q"), "p_brand", 4)


@query
def hist_values(spark, d):
    return H.histogram(load(spark, d, "lineitem"), quantity())


@query
def hist_dual_bins(spark, d):
    return H.dual_histogram(load(spark, d, "lineitem"), quantity(), 2)


@query
def dedup_sorted(spark, d):
    return H.sorted_distinct(load(spark, d, "part"), "p_size", "p_brand")


@query
def symbol_cost(spark, d):
    return H.symbol_costs(load(spark, d, "events"), "event_type", "user_id")


@query
def census_counters(spark, d):
    orders, items = load(spark, d, "orders"), load(spark, d, "lineitem")
    return H.counters(orders, "order_status", F.col("o_orderstatus")).unionByName(H.counters(orders, "priority", F.col("o_orderpriority"))).unionByName(
        H.counters(items, "return_flag", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    )


# ---- look-ups ----

CACHE = [2, 7, 11, 18, 25, 31, 40, 48]
SEEDS = [5, 15, 25, 45]


@query
def snap_to_cache(spark, d):
    hist = H.histogram(load(spark, d, "lineitem"), quantity())
    return hist.select("value", "n", L.nearest(F.col("value"), CACHE).alias("x")).select("value", "n", F.col("x.index").alias("idx"), F.col("x.value").alias("snapped"), F.col("x.distance").alias("distance"))


@query
def kmeans_3_steps(spark, d):
    return L.kmeans_steps(H.histogram(load(spark, d, "lineitem"), quantity()), SEEDS, 3)


@query
def nearest_centroid(spark, d):
    b = _blocks(spark, d)
    return L.nearest_block(b, b.groupBy("label").agg(F.min_by("b", "vec_id").alias("b")))


@query
def cached_vs_new(spark, d):
    cache = load(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return L.split_by_cache(load(spark, d, "part"), cache, "p_partkey").groupBy("p_brand", "cached").agg(F.count("*").alias("n"))


@query
def merge_palettes(spark, d):
    parts = load(spark, d, "part").select("p_brand", "p_size", "p_partkey")
    return L.merge_sorted(parts.filter("p_partkey % 3 = 0"), parts.filter("p_partkey % 3 = 1"), "p_brand", "p_size")


@query
def bucket_join_capped(spark, d):
    items = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    arrival = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return L.capped_bucket_matches(items, items, F.col("l_partkey") % 65536, ["l_partkey", "l_suppkey"], arrival, 256)


INTERVALS = [
    (0, "2024-01-03 00:00:00", "2024-01-06 12:00:00"),
    (1, "2024-01-05 00:00:00", "2024-01-09 00:00:00"),
    (2, "2024-01-09 00:00:00", "2024-01-09 06:30:00"),
    (3, "2024-01-12 08:00:00", "2024-01-20 00:00:00"),
    (4, "2024-01-01 00:00:00", "2024-01-31 00:00:00"),
    (5, "2024-01-15 00:00:00", "2024-01-16 00:00:00"),
]


@query
def interval_lookup(spark, d):
    rows = ", ".join(f"({i}, TIMESTAMP_NTZ'{a}', TIMESTAMP_NTZ'{b}')" for i, a, b in INTERVALS)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t(idx, start, end)")
    return L.first_interval(load(spark, d, "events"), "ts", "event_id", entries)


POINTS = [(8, 20), (40, 64), (90, 70), (200, 255)]


@query
def scaling_lut(spark, d):
    x = clamp(F.floor("value"), 0, 255)
    return load(spark, d, "events").select("event_id", x.alias("x")).select("event_id", "x", L.piecewise(F.col("x"), POINTS).alias("y"))


FEATURES = {0: -20, 1: 0, 2: 15, 3: 40, 5: -60, 6: 7, 7: 100}


@query
def segment_features(spark, d):
    c = load(spark, d, "customer")
    out = L.with_segment(c, (F.col("c_custkey") % 8).cast("int"), FEATURES, F.col("c_nationkey") * 9)
    return out.groupBy("segment", "q").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_custkey"))


@query
def rd_argmin(spark, d):
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    candidates = [((i + 1) * (size + 100), (size * (37 + i) + key) % 211 * (5 - i)) for i in range(5)]
    return load(spark, d, "part").select("p_partkey", L.least_cost(candidates, 300).alias("x")).select("p_partkey", F.col("x.candidate").alias("candidate"), F.col("x.cost").alias("cost"))


# ---- blocks ----


@query
def block_sad_sse_var(spark, d):
    return B.block_errors(B.neighbours(_blocks(spark, d), 64))


@query
def hadamard_satd(spark, d):
    t = B.transformed(_blocks(spark, d), B.HADAMARD, "bigint")
    return t.select("vec_id", B.total(F.transform("t", F.abs)).alias("satd"), F.col("t")[0].alias("dc"))


QUANT = {"zbin": (40, 48), "rounding": (20, 16), "quant": (17000, 9000), "shift": (2048, 1024)}
STEP = (64, 96)


def _quantised(spark, d) -> DataFrame:
    b = _blocks(spark, d)
    return b.withColumn("q", F.transform("b", lambda x, i: B.quantised(x, i, **QUANT)))


@query
def deadzone_quantize(spark, d):
    q = _quantised(spark, d)
    return q.select("vec_id", F.size(F.filter("q", lambda x: x != 0)).cast("bigint").alias("n_levels"), B.total(F.transform("q", F.abs)).alias("sum_levels"), B.last_nonzero(F.col("q")).alias("eob"))


@query
def dequant_error(spark, d):
    back = F.transform("q", lambda q, i: q * F.when(i == 0, F.lit(STEP[0])).otherwise(F.lit(STEP[1])))
    q = _quantised(spark, d).withColumn("back", back)
    return q.select("vec_id", B.total(F.zip_with("b", "back", lambda x, y: (x - y) * (x - y))).alias("error"), B.total(F.transform("b", lambda x: x * x)).alias("energy"))


def _levels(spark, d) -> DataFrame:
    return _blocks(spark, d).withColumn("q", F.transform("b", lambda x: F.shiftright(F.abs(x), 6)))


@query
def scan_eob(spark, d):
    return _levels(spark, d).select("vec_id", B.last_nonzero(F.transform("q", lambda x: F.shiftright(x, 1)), B.SCAN).alias("eob"), B.last_nonzero(F.transform("q", lambda x: F.shiftright(x, 1))).alias("raster_eob"))


@query
def nz_neighbours(spark, d):
    low = _levels(spark, d).withColumn("b", F.transform("q", lambda x: F.least(x, F.lit(3))))
    near = B.added([B.shifted("b", dr, dc, False) for dr, dc in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0))])
    ctx = low.select("vec_id", F.transform(near, lambda x: F.least(F.shiftright(x + 1, 1), F.lit(4))).alias("ctx"))
    return ctx.select("vec_id", B.total(F.col("ctx")).alias("total"), F.array_max("ctx").alias("most"), F.col("ctx")[0].alias("first"))


@query
def box_sum_5x5(spark, d):
    s = B.box_sums(_blocks(spark, d))
    return s.select("vec_id", B.total(F.col("b")).alias("total"), F.array_min("b").alias("low"), F.array_max("b").alias("high"), F.col("b")[27].alias("centre"))


@query
def fir_separable(spark, d):
    s = B.separable_filter(_blocks(spark, d), [1, 4, 6, 4, 1], 4)
    return s.select("vec_id", B.total(F.col("b")).alias("total"), F.array_min("b").alias("low"), F.array_max("b").alias("high"), F.col("b")[0].alias("corner"))


@query
def gradient_hist(spark, d):
    return B.gradient_histogram(_blocks(spark, d))


@query
def dominant_direction(spark, d):
    return B.dominant_direction(_blocks(spark, d))


@query
def variance_rollup(spark, d):
    return B.variance_rollup(_blocks(spark, d))


@query
def split_or_not(spark, d):
    return B.split_costs(_blocks(spark, d), 6000)


@query
def octile_variance(spark, d):
    node = _blocks(spark, d).select("vec_id", B.node_sums(F.col("b"), 8)[0].alias("x"))
    v = node.select(div(F.col("vec_id"), 64).alias("superblock"), F.shiftright(F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6), 6).alias("v"))
    v = v.groupBy("superblock").agg(F.sort_array(F.collect_list("v")).alias("a")).filter(F.size("a") >= 48)
    a = F.col("a")
    return v.select("superblock", div(a[31] + a[39] * 2 + a[47] + 2, 4).alias("octile"))


@query
def flat_blocks(spark, d):
    g = _blocks(spark, d).select("vec_id", B.gradients(F.col("b")).alias("g"), B.node_sums(F.col("b"), 8)[0].alias("x"))
    of = lambda f: B.total(F.transform("g", f))
    m = g.select("vec_id", of(lambda t: t["dx"] * t["dx"]).alias("xx"), of(lambda t: t["dx"] * t["dy"]).alias("xy"), of(lambda t: t["dy"] * t["dy"]).alias("yy"), (F.col("x.ss") - F.shiftright(F.col("x.s") * F.col("x.s"), 6)).alias("variance"))
    trace = F.col("xx") + F.col("yy")
    root = F.sqrt(((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + F.col("xy") * F.col("xy") * 4).cast("double"))
    e = m.withColumn("trace", trace).withColumn("e1", F.round((trace + root) / 2, 3)).withColumn("e2", F.round((trace - root) / 2, 3))
    flat = (F.col("trace") < 1_500_000) & (F.col("e1") < F.col("e2") * 1.5) & (F.col("variance") > 500_000)
    return e.select("vec_id", "trace", "e1", "e2", "variance", flat.alias("flat"))


@query
def dct_8x8(spark, d):
    t = B.transformed(_blocks(spark, d), B.DCT, "double")
    return t.select("vec_id", F.posexplode("t").alias("k", "x")).select("vec_id", "k", (F.round("x", 5) + 0.0).alias("coef"))


@query
def freq_energy(spark, d):
    t = B.transformed(_blocks(spark, d), B.DCT, "double", rows_too=False)
    energy = lambda k: sum((F.col("t")[r * 8 + k] * F.col("t")[r * 8 + k] for r in range(1, 8)), F.col("t")[k] * F.col("t")[k])
    e = t.select("label", F.array(*(energy(k) for k in range(8))).alias("e"))
    upward = [(k, sum((F.col("e")[j] for j in range(k + 1, 8)), F.col("e")[k])) for k in range(1, 8)]
    rows = e.select("label", F.explode(F.array(*(F.struct(F.lit(k).alias("freq"), x.alias("energy")) for k, x in upward))).alias("x"))
    return rows.groupBy("label", F.col("x.freq").alias("freq")).agg(F.round(F.sum("x.energy"), 3).alias("energy"))


# ---- sequences ----


@query
def leb128_sizes(spark, d):
    return load(spark, d, "orders").groupBy(leb128_size(F.col("o_orderkey")).alias("size")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query
def tile_offsets(spark, d):
    sizes = load(spark, d, "orders").select("o_orderkey", (leb128_size(F.col("o_orderkey")) + F.length("o_orderpriority")).cast("bigint").alias("size"))
    return S.offsets(sizes, "o_orderkey", "size", 4096)


@query
def delta_code(spark, d):
    return S.deltas(load(spark, d, "part"), "p_brand", "p_size")


@query
def cdf_adapt(spark, d):
    types = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    return S.adapted_probabilities(_events(spark, d).withColumn("symbol", types), ["user_id", "day"], "event_id", "symbol", 5)


@query
def candidate_stack(spark, d):
    items = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("key"), quantity().alias("w"), "l_linenumber")
    return S.candidate_stack(items, "l_orderkey", "key", "w", "l_linenumber", 8, 2, 640)


@query
def last_writer_grid(spark, d):
    return S.last_writers(load(spark, d, "events"), {"cell_r": F.col("user_id") % 4, "cell_c": F.hour("ts")}, "event_id", "value")


@query
def slot_states(spark, d):
    return slot_state(load(spark, d, "events"))


@query
def edge_masks(spark, d):
    m = S.edge_mask(_events(spark, d), ["user_id", "day"], "event_id", "v", 900, 2400)
    return m.groupBy("user_id").agg(F.count("masked").alias("n"), F.count_if("masked").alias("n_smooth"))


@query
def autocov_window(spark, d):
    return S.lag_products(_events(spark, d), ["user_id", "day"], "event_id", "v", 4)


@query
def noise_strength_bins(spark, d):
    s = F.floor(F.col("l_discount") * 100 + 0.5)
    return S.strength_bins(load(spark, d, "lineitem"), quantity(), s, 1, 7, 8)


@query
def upscale_1d(spark, d):
    e = _events(spark, d).withColumn("hour", F.hour("ts")).groupBy("day", "hour").agg(F.sum("v").alias("v"))
    return S.upscaled(e, "day", "hour", "v")


@query
def round_shift_levels(spark, d):
    return load(spark, d, "part").groupBy(round_shift(F.col("p_partkey"), 5).alias("level")).agg(F.count("*").alias("n"))
