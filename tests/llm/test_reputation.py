"""The posterior bound against a fine numerical integral of the beta density."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import urls


def above(a, b, x):
    u = np.linspace(-60 / min(a, 1) - 60, 60 / min(b, 1) + 60, 2_000_001)
    log = -a * np.logaddexp(0, -u) - b * np.logaddexp(0, u)
    density = np.exp(log - log.max())
    return density[u > np.log(x / (1 - x))].sum() / density.sum()


def test_chance_above(spark):
    cases = [(0.001, 2.0), (0.5, 0.5), (1.0, 1.0), (2.0, 0.05), (3.5, 1.2), (9.0, 2.0), (11.0, 4.0), (60.0, 41.0), (300.0, 250.0), (5000.0, 5200.0), (40.0, 0.001), (1e6, 1e3)]
    df = spark.createDataFrame(cases, "a double, b double")
    for x in (0.5, 0.2):
        got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", urls.chance_above(F.col("a"), F.col("b"), x).alias("p")).collect()}
        for a, b in cases:
            assert abs(got[a, b] - above(a, b, x)) < 5e-3, (a, b, x, got[a, b], above(a, b, x))


def test_few_labels_need_more_than_the_mean(spark):
    """Two bad pages of two are no proof; thirty of thirty are."""
    pages = spark.range(332).select(F.col("id").alias("page_id"), F.when(F.col("id") < 2, "x://few.info/").when(F.col("id") < 32, "x://many.org/").otherwise(F.concat(F.lit("x://h"), F.col("id") % 50, F.lit(".com/"))).alias("url"))
    labels = pages.select("page_id", (F.col("page_id") < 32).cast("int").alias("bad"))
    got = {r["host"]: r["verdict"] for r in urls.judge_urls(pages, labels, rules=[]).collect()}
    assert (got["many.org"], got["h7.com"]) == ("block", "allow")
    assert got["few.info"] in ("allow", "block")
