"""Queries that SQL can't express, against plain Python over the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pytest

from tessera.llm import html, packing, queries, secrets, tokenfiles, tokens
from tessera.llm.common import table

from ..conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    return tokens.Encoder().tokenizer


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op2(spark):
    turns = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [(role, text) for _, _, role, text in queries.PLANTED_CONVERSATION]
    got = {r["conv_id"]: r for r in queries.op2_chat_formatting(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        loss = "".join(text for role, text in said if role == "assistant")
        assert got[conv]["n_turns"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] > sum(len(t) for _, t in said)


def test_op3(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r for r in queries.op3_html_extraction(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for page_id, page in pages.items():
        article = re.search("<article>(.*?)</article>", page["html"], re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub("</?b>|<br>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert (got[page_id]["text"], got[page_id]["n_chars"], got[page_id]["url"]) == (want, len(want), page["url"])


def test_op3_layouts():
    long = "Prose that goes on for a while, with clauses and no links in it. " * 3
    page = f"""<html><head><title>No</title></head><body class="has-sidebar"><header>Site</header><div id="main-menu"><a href=/>Home</a></div>
      <div class="cookie-notice">We use cookies</div><main><h1>Title</h1><p>Short.</p><div class=ad>Buy</div><p>{long}<p>A &lt;b&gt;&nbsp; c<sup>2</sup>
      <ul><li>one</li><li>two</li></ul><form><input><p>Mail me</p></form><section class="comments"><p>First!</p></section><p>End.</p></main>
      <aside>Side</aside><footer>&copy;</footer><script>var x = "<p>no</p>"</script></body></html>"""
    assert html.main_text(page) == "\n".join(["Title", "Short.", " ".join(long.split()), "A <b> c2", "one", "two", "End."])
    soup = f"<div class=nav><a href=1>One</a></div><div><h2>T</h2><p>{long}</p><p>Last.</p></div><div class='footer'>x</div>"
    assert html.main_text(soup) == f"T\n{long.strip()}\nLast."
    for broken in (None, "", "<", "<p", "<p>x<scr", "</p></p>", "<script>", "<!-- ", "<div hidden>x", "a<b"):
        html.main_text(broken)
    assert html.main_text("<article>caf&eacute &amp;amp; &am") == "café &amp; &am"


def test_op3_attributes():
    kept = ['data-id="ad"', 'title="Hidden lakes"', 'style="overflow: hidden"', 'class="has-sidebar"', "class='no-comments wide'", 'data-x="a class=menu b"', 'id="header-of-article"', 'alt="id=footer"', "class", 'role="region"']
    dropped = ["hidden", 'class="wide ad"', "id=footer", "CLASS='Related-Posts'", 'role="navigation"', 'aria-hidden="true"', "data-n=1 hidden=''", 'title="x" class="no-border menu"']
    for attributes in kept:
        assert html.main_text(f"<article><p>a<div {attributes}>b</div></article>") == "a\nb", attributes
    for attributes in dropped:
        assert html.main_text(f"<article><p>a<div {attributes}>b</div></article>") == "a", attributes
    assert html.main_text("<div class=page-header>Site</div><article><div class=entry-header><h1>T</h1></div>a</article>") == "T\na"


def test_op5(spark, documents, library):
    got = sorted(queries.op5_token_files(spark, SF).collect())
    start = 0
    for row, doc_id in zip(got, sorted(documents), strict=True):
        ids = library.encode(documents[doc_id], add_special_tokens=False).ids + [tokenfiles.END_ID]
        assert tuple(row) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_op5_random_access(spark, documents, library):
    files = tokenfiles.write_tokens(table(spark, SF, "documents"), shard_docs=50, segment_tokens=3000)
    assert files.select("shard").distinct().count() > 1
    for segment in files.limit(5).collect():
        levels = [level.asDict() for level in segment["levels"]]
        whole = tokenfiles.dac_ids(levels)
        for doc in segment["docs"]:
            ids = library.encode(documents[doc["doc_id"]], add_special_tokens=False).ids + [tokenfiles.END_ID]
            at = doc["start"] - segment["first"]
            assert whole[at : at + doc["n_tokens"]].tolist() == ids
            assert tokenfiles.token_at(levels, at + len(ids) // 2) == ids[len(ids) // 2]


def test_dac_levels():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 1 << 16, 3000), rng.integers(0, 1 << 32, 3000)]).astype(np.uint32)
    rng.shuffle(ids)
    levels = tokenfiles.dac_levels(ids)
    assert len(levels) == 4
    assert (tokenfiles.dac_ids(levels) == ids).all()
    assert all(tokenfiles.token_at(levels, i) == ids[i] for i in range(len(ids)))


def test_encoder_equals_library(library):
    import random

    rng = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2C0, 0x3D0), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x180E, 0x1F600, 0x4F60, 0xAC00, 0x1100, 0x1161]]
    texts = ["".join(rng.choice(alphabet + [" "] * 60) for _ in range(30)) for _ in range(1500)]
    texts += ["", "a\x1cb \x00 c", "\x00", "it's 's don't <|endoftext|> <|startoftext|>x", "ΑΣ Σ ΟΔΟΣ", "İstanbul ẞ ﬁ", "x, y. z! (w) a,b c.,"]
    own = tokens.Encoder()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_op6(spark):
    larger = SF.replace("0.001", "0.01")  # the smallest tables hold no secret
    documents = {r["doc_id"]: r["text"] for r in table(spark, larger, "documents").collect()}
    planted = {
        (doc_id, m.start(1), len(m[1]))
        for doc_id, text in documents.items()
        for m in re.finditer(r'(?:(?:token = "|password=)|\b(?=AKIA))([0-9A-Za-z]{16,})', text)
    }
    got = {(r["doc_id"], r["start"], r["length"]): r["sha256"] for r in queries.op6_secret_scan(spark, larger).collect()}
    assert planted and got.keys() == planted
    for (doc_id, start, n), digest in got.items():
        assert digest == hashlib.sha256(documents[doc_id][start : start + n].encode()).hexdigest()


def test_op6_held_out(spark):
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    rows = secrets.labelled_findings(spark, 2000, seed=77)
    found = {r["doc_id"] for r in secrets.find_secrets(rows.withColumnRenamed("id", "doc_id"), forest).collect()}
    labels = {r["id"]: r["label"] for r in rows.collect()}
    right = sum((i in found) == (label == 1) for i, label in labels.items())
    assert right / len(labels) > 0.97


def fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps):
    """Union-find over all pairs."""
    keys, parent = list(fps), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_op7(spark, documents):
    fps = {doc_id: fingerprint(text) for doc_id, text in documents.items()}
    want = least_reachable(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, SF).collect()}
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in documents}
    assert any(k != v for k, v in want.items())


def test_op8(spark, documents, library):
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    check_packing({k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in documents.items()}, rows)


def check_packing(ids_of, rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids_of.keys()
    lengths = defaultdict(int)
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["length"]) == (i, at, min(2048, len(ids) - at))
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
            lengths[r["length"]] += 1
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= packing.lower_bound(lengths) * 1.01 + 1


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 6000).astype(int) + 1).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    apart = packing.assign(df, part_pieces=300, rounds=0).select("sequence_id").distinct().count()
    placed = packing.assign(df, part_pieces=300).collect()
    bound = packing.lower_bound({x: lengths.count(x) for x in set(lengths)})
    assert len({r["sequence_id"] for r in placed}) <= min(apart, bound + 4)
    assert sorted(r["key"] for r in placed) == list(range(6000))
    filled = defaultdict(int)
    for r in placed:
        filled[r["sequence_id"]] += lengths[r["key"]]
    assert max(filled.values()) <= 2048


def test_lower_bound_is_one():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 11, 6).tolist()
        least = min(sum_bins(p, 10) for p in permutations(lengths))
        assert packing.lower_bound({x: lengths.count(x) for x in set(lengths)}, 10) <= least


def sum_bins(order, capacity):
    bins = []
    for x in order:
        for i, room in enumerate(bins):
            if room >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)
