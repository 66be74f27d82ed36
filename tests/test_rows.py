"""k-means of a row's values, staged search, and noise by jumps, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import noise as Z
from tessera.operators import palettes as A
from tessera.operators import search as X

from .test_planes import COLS, ROWS, blocks, planes


def test_block_kmeans_settles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-50, 50, 16).tolist()) for i in range(30)] + [(90, [5] * 16), (91, [-7, -8] * 8)]
    got = {(r["id"], r["k"]): r for r in A.block_kmeans(spark.createDataFrame(rows, "id long, b array<long>"), "id", [2, 3, 8]).collect()}
    assert len(got) == 3 * len(rows)
    for i, values in rows:
        low, high = min(values), max(values)
        for k in (2, 3, 8):
            c, steps = [low + (2 * j + 1) * (high - low) // (2 * k) for j in range(k)], 0
            while True:
                of = [min(range(k), key=lambda j: (abs(v - c[j]), j)) for v in values]
                mine = [[v for v, o in zip(values, of, strict=True) if o == j] for j in range(k)]
                now, steps = [(sum(m) + len(m) // 2) // len(m) if m else x for m, x in zip(mine, c, strict=True)], steps + 1
                if now == c:
                    break
                c = now
            r = got[i, k]
            assert (r["centroids"], r["steps"]) == (c, steps)
            assert r["error"] == sum(min((v - x) ** 2 for x in c) for v in values)
    assert A.block_kmeans(spark.createDataFrame([], "id long, b array<long>"), "id", [2]).count() == 0


def test_staged_search(spark):
    after, before = planes(3, 0, 99), planes(4, 0, 99)
    before[0, 11:19, 21:29] = after[0, 8:16, 16:24]  # found where a stage's site is it
    padded = np.pad(before, ((0, 0), (7, 7), (7, 7)))
    sad = lambda f, y, x, dy, dx: int(np.abs(padded[f, y + dy + 7 : y + dy + 15, x + dx + 7 : x + dx + 15] - after[f, y : y + 8, x : x + 8]).sum())
    for side in (8, 64):
        got = X.staged_search(blocks(spark, after), blocks(spark, before), [4, 2, 1], side).collect()
        assert len(got) > 70
        for r in got:
            f, y, x = r["frame"], r["r"] * 8, r["c"] * 8
            best = (sad(f, y, x, 0, 0), 0, 0)
            for step in (4, 2, 1):
                cy, cx = best[1:]
                for dy, dx in X.sites(step):
                    best = min(best, (sad(f, y, x, cy + dy, cx + dx), cy + dy, cx + dx), key=lambda b: b[0])
            assert (r["sad"], r["dy"], r["dx"]) == best
            assert r["best_sad"] == min(sad(f, y, x, dy, dx) for dy in range(-7, 8) for dx in range(-7, 8))
        assert {r["best_sad"] for r in got if (r["frame"], r["r"], r["c"]) == (0, 1, 2)} == {0}


def test_states_by_jumps(spark):
    state, want = 4711, []
    for _ in range(3000):
        want.append(state)
        state = state >> 1 | ((state ^ state >> 1 ^ state >> 3 ^ state >> 12) & 1) << 15
    got = [r["s"] for r in spark.range(3000).select("id", Z.state_after(4711, F.col("id")).alias("s")).orderBy("id").collect()]
    assert got == want
    assert spark.range(1).select(Z.state_after(F.lit(4711), F.lit(65535 * 15 + 7)).alias("s")).first()["s"] == want[7]  # the period is 65535
