"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing to weights, packing; each on what the last kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

Edge cases are those of the stages' operators: nulls, repeated rows and empty tables pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, secrets, simhash
from tessera.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Not expressible in SQL: fingerprints, the trained forest and packing.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps every document."""
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    return secrets.redact(docs, forest).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents to its share of the budget; a document comes once for each epoch that takes it."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
