"""Grain tables: a text file of entries, each a line ``E start end apply seed update`` with parameter lines under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first line of a table.
MAGIC = "filmgrn1"
HEAD = r"^E(?: [0-9]+){5}$"


def parsed(files: DataFrame) -> DataFrame:
    """(name, start, end, apply, seed, update, params) from (name, value), ``value`` a whole table's text.

    ``params``: an array of (kind, values) in order. A text without the first line, and entries whose head isn't of its
    form, have no rows.
    """
    whole = files.filter(F.col("value").startswith(f"{MAGIC}\n"))
    entry = whole.select("name", F.explode(F.split(F.col("value"), r"\n(?=E )")).alias("entry")).select("name", F.split(F.regexp_replace("entry", r"\s+$", ""), r"\n").alias("l"))
    head = F.split(F.col("l")[0], " ")
    words = F.transform(F.slice("l", 2, F.size("l")), lambda x: F.split(F.trim(F.translate(x, "\t", " ")), " +"))
    params = F.transform(words, lambda w: F.struct(w[0].alias("kind"), F.transform(F.slice(w, 2, F.size(w)), lambda x: x.cast("bigint")).alias("values")))
    rows = entry.filter(F.col("l")[0].rlike(HEAD))
    fields = (head[1].cast("bigint").alias("start"), head[2].cast("bigint").alias("end"), (head[3] == "1").alias("apply"), head[4].cast("int").alias("seed"), head[5].cast("int").alias("update"))
    return rows.select("name", *fields, params.alias("params"))


def line_of() -> Column:
    """The text of an entry of ``parsed``."""
    head = F.concat_ws(" ", F.lit("E"), "start", "end", F.col("apply").cast("int"), "seed", "update")
    params = F.transform("params", lambda x: F.concat_ws(" ", F.concat(F.lit("\t"), x["kind"]), x["values"].cast("array<string>")))
    return F.concat_ws("\n", head, params)


def read_grain(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the table files at ``path``; ``name`` is the folder's that ``write_grain`` gave it, else the file's path."""
    files = spark.read.text(path, wholetext=True)
    name = F.col("name") if "name" in files.columns else F.col("_metadata.file_path")
    return parsed(files.select(name.cast("string").alias("name"), "value"))


def write_grain(entries: DataFrame, path: str) -> None:
    """One text file a name, in a folder of that name, entries by start. A table is written by one task, as sorted lines."""
    lines = entries.select("name", "start", "end", line_of().alias("value"))
    heads = entries.select("name").distinct().select("name", F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit(MAGIC).alias("value"))
    dealt = heads.unionByName(lines).repartition("name").sortWithinPartitions("name", F.asc_nulls_first("start"), F.asc_nulls_first("end"), "value")
    dealt.select("name", "value").write.partitionBy("name").text(path)
