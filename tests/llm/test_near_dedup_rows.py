"""Which rows stay: by row, not by doc_id; and hot cells."""

import numpy as np

from tessera.llm import components, simhash

WORDS = "ships harbours grain north price river stone lamp winter glass copper letter garden violin thunder bread".split()


def text(i):
    """Texts that are far from each other."""
    return " ".join(WORDS[(i * 7 + k * (2 * i + 3)) % len(WORDS)] + str(i) for k in range(60))


A, B, C, D, E, F = map(text, range(6))
#: Rows, and those that stay, of groups that have nothing to do with each other.
CASES = [
    ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
    ([(None, C), (None, C), (None, D)], [(None, C), (None, D)]),
    ([(15, E), (15, E), (9, E)], [(9, E)]),
    ([(7, None), (6, ""), (6, ""), (8, " ")], [(6, "")]),
    ([(13, F), (None, F)], [(13, F), (None, F)]),
]


def test_rows_that_stay(spark):
    rows = [row for given, _ in CASES for row in given]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((row for _, want in CASES for row in want), key=str)


def test_texts_are_not_shuffled_and_lists_change_nothing(spark):
    rows = [(*row, lang, i % 3) for i, row in enumerate(row for given, _ in CASES for row in given) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    few, many = simhash.drop_near_duplicates(df.repartition(3)), simhash.drop_near_duplicates(df.repartition(7), dropped_list=0)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("Exchange" in line and "text" in line for line in plan.splitlines())
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()


def test_which_of_equal_rows_stays_is_defined(spark):
    rows = [(1, A, lang, source) for lang in ("en", "de", None) for source in ("src1", "src2", None)]
    kept = {simhash.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string, lang string, source string").repartition(n)).first() for given in (rows, rows[::-1]) for n in (1, 4)}
    assert len(kept) == 1


def test_split_cells_link_the_same(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in rng.integers(1, 9, 1500)]
    fps = np.unique(np.concatenate([centres, *(c ^ np.array(flips[i::4]) for i, c in enumerate(centres))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    whole, split = ({r["node"]: r["root"] for r in components.components(simhash.links(df, hot_cell=h)).collect()} for h in (1 << 16, 20))
    every = {r["node"]: r["root"] for r in components.components(simhash.links(df, hot_cell=0, hot_list=0)).collect()}
    assert whole == split == every and len(whole) > 200


def test_a_large_cell_is_compared_fast():
    """A million fingerprints of one cell: a group of near copies, and others without a link."""
    rng = np.random.default_rng(5)
    near = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (4, 100_000)).astype(np.uint64), axis=0))
    apart = rng.integers(0, 2**63, 900_000, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, apart]))
    i, j = simhash.forest(fps)
    assert (np.bitwise_count(fps[i] ^ fps[j]) <= 3).all()
    linked = np.zeros(len(fps), bool)
    linked[i] = linked[j] = True
    assert linked[np.searchsorted(fps, near)].mean() > 0.9 and len(i) < 4 * len(fps)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (6, 3000)).astype(np.uint64), axis=0))

    def roots(a, b):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            parent[y] = x
        return [find(x) for x in range(len(fps))]

    every = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)).T
    assert len(fps) > simhash.PLAIN_FOREST
    assert roots(*simhash.forest(fps)) == roots(*every)
