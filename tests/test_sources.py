"""Grain tables: text in, entries, text out; and checksums and codes at their edges."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import models as M
from tessera.operators import sequences as S
from tessera.sources import grain

TABLE = "filmgrn1\nE 0 100 1 77 1\n\tp 3 6 0\n\tsY 1  20 30\nE 100 250 0 9 0\nbroken\nE 250 x 1 1 1\n\tp 1\nE 300 400 1 5 1\n"


def test_grain_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tbl").write_text(TABLE)
    (tmp_path / "in" / "b.tbl").write_text("another format\nE 0 1 1 1 1\n")
    got = grain.read_grain(spark, str(tmp_path / "in")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["apply"], r["seed"]) for r in got] == [(0, 100, True, 77), (100, 250, False, 9), (300, 400, True, 5)]
    assert [(p["kind"], p["values"]) for p in got[0]["params"]] == [("p", [3, 6, 0]), ("sY", [1, 20, 30])]
    grain.write_grain(grain.read_grain(spark, str(tmp_path / "in")).withColumn("name", F.lit("t")), str(tmp_path / "out"))
    again = grain.read_grain(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [r["name"] for r in again] == ["t"] * 3 and [r[1:] for r in again] == [r[1:] for r in got]


def test_crc32c(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",), (b"\x00" * 32,)], "b binary")
    assert [r["crc"] for r in df.select(M.crc32c(F.col("b")).alias("crc")).collect()] == [0xE3069283, 0, 0x8A9136AA]


@pytest.mark.parametrize(("digits", "value"), [("00", 0), ("7F", 127), ("8001", 128), ("FFFFFFFF0F", 2**32 - 1), ("FFFFFFFF1F", None), ("80", None), ("0001", None), ("", None), ("80" * 8 + "01", None)])
def test_leb128_value(spark, digits, value):
    assert spark.range(1).select(M.leb128_value(F.lit(digits)).alias("v")).first()["v"] == value


def test_offsets_at_several_levels(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    for levels in (0, 1, 2, 3):
        got = {r["k"]: r["offset"] for r in S.offsets(df, "k", "n", 8, levels).collect()}
        assert got == {k: sum(i % 7 for i in range(k)) for k in range(1000)}


def test_clamped_sums_in_ranges(spark):
    steps = [(1, i, (i * 7919) % 41 - 20) for i in range(500)]
    df = spark.createDataFrame(steps, "g long, at long, x long")
    carry = 60
    for _, _, x in steps:
        carry = min(max(carry + x, 0), 127)
    for group in (1, 10, 4096):
        assert tuple(S.clamped_sums(df, ["g"], "at", "x", 60, 0, 127, group).first()) == (1, 500, carry)


def test_first_interval_keeps_rows_with_one_key(spark):
    from tessera.operators import lookups as L

    events = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (1, TIMESTAMP_NTZ'2024-01-05 00:00:00') AS t(id, ts)")
    entries = spark.sql("SELECT * FROM VALUES (0, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(idx, start, end)")
    assert sorted(map(tuple, L.first_interval(events, "ts", "id", entries).collect()), key=str) == [(1, 0), (1, None)]
