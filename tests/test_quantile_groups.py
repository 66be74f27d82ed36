"""exact_quantiles: rows are counted where they lie; a null in a group's key is a group."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as E


@pytest.mark.parametrize("groups", [0, 1 << 16])
def test_null_keys_and_many_groups(spark, groups):
    df = spark.createDataFrame([(g, h, v) for g in ("a", None) for h in (1, None) for v in range(-50, 51)] + [("b", 1, None)], "g string, h int, v long")
    got = {(r["g"], r["h"]): r["v"] for r in E.exact_quantiles(df, ["g", "h"], "v", 0.9, groups).collect()}
    assert got == {(g, h): 40 for g in ("a", None) for h in (1, None)}


def test_rows_of_a_large_group_are_not_sorted(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") * 7 % 5000).alias("v"))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        found = E.exact_quantiles(df, ["g"], "v", 0.5)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("a", 2499)]
    finally:
        spark.conf.set(key, before)
