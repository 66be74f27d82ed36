"""The pipeline's stages, each against plain Python on what the stage before kept."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.common import stored, table

from ..conftest import SF
from ..oracle import duck
from .test_brute import fingerprint, least_reachable, library  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return [table(spark, SF, "documents"), *out]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(stages):
    from tessera.llm.sql import OP9

    names, rows = duck(OP9, SF)
    kept = {row[names.index("doc_id")] for row in rows if row[names.index("kept")]}
    assert texts(stages[1]) == {k: v for k, v in texts(stages[0]).items() if k in kept}


def test_dedup(stages):
    before = texts(stages[1])
    roots = least_reachable({k: fingerprint(t) for k, t in before.items()})
    assert texts(stages[2]) == {k: t for k, t in before.items() if roots[k] == k}
    assert stages[2].count() < stages[1].count()


def test_secrets(stages):
    secret = re.compile(r'((?:token = "|password=)|\b(?=AKIA))([0-9A-Za-z]{16,})')
    before = texts(stages[2])
    assert texts(stages[3]) == {k: secret.sub(r"\1[SECRET]", t) for k, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mixing(stages):
    from tessera.llm.sql import OP1

    import duckdb

    con = duckdb.connect()
    given = stages[3].toArrow()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    want = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({OP1})").fetchall())
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want
    before = texts(stages[3])
    assert all(before[r["doc_id"]] == r["text"] for r in stages[4].collect())


def test_packing(stages, library):  # noqa: F811
    from tessera.llm.tokens import wide

    copies = Counter(r["doc_id"] for r in stages[4].collect())
    ids = {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in texts(stages[4]).items()}
    rows = stages[5].collect()
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == Counter({(k, i): copies[k] for k in ids for i in range(-(-len(ids[k]) // 2048))})
    for r in rows:
        assert wide(r["ids"], r["length"]) == np.asarray(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
    total = sum(filled.values())
    assert len(filled) <= total / 2048 * 1.05 + 1


def test_run_has_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_domains():
    assert sum(map(len, mixing.DOMAINS.values())) == 20
