"""Planes against whole arrays in NumPy: small tiles, so that borders are everywhere; missing blocks; collisions of hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import copies as C
from tessera.operators import planes as P
from tessera.operators import quadtree as Q
from tessera.operators import quantiles as E
from tessera.operators import systems as Y
from tessera.operators import transforms as T

ROWS, COLS = 6, 7
MISSING = {(0, 3), (4, 0), (5, 6)}


def planes(seed: int, low: int, high: int) -> np.ndarray:
    cells = np.random.default_rng(seed).integers(low, high, (2, ROWS * 8, COLS * 8))
    for r, c in MISSING:
        cells[1, r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = 0
    return cells


def blocks(spark, cells: np.ndarray):
    rows = [(f, r, c, cells[f, r * 8 : r * 8 + 8, c * 8 : c * 8 + 8].ravel().tolist()) for f in range(2) for r in range(ROWS) for c in range(COLS) if f == 0 or (r, c) not in MISSING]
    return spark.createDataFrame(rows, "frame long, r long, c long, b array<long>").repartition(5)


def whole(df, dtype=np.int64) -> np.ndarray:
    out = np.zeros((2, ROWS * 8, COLS * 8), dtype)
    rows = df.collect()
    assert len(rows) == 2 * ROWS * COLS - len(MISSING)
    for x in rows:
        out[x["frame"], x["r"] * 8 : x["r"] * 8 + 8, x["c"] * 8 : x["c"] * 8 + 8] = np.array(x["b"]).reshape(8, 8)
    return out


def there() -> np.ndarray:
    mask = np.ones((2, ROWS * 8, COLS * 8), bool)
    for r, c in MISSING:
        mask[1, r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = False
    return mask


@pytest.mark.parametrize("side", [8, 16, 64])
def test_box_sums_cross_borders(spark, side):
    cells = planes(1, -50, 50)
    around = np.pad(cells, ((0, 0), (3, 3), (3, 3)))
    want = sum(around[:, i : i + ROWS * 8, j : j + COLS * 8] for i in range(7) for j in range(7)) * there()
    assert (whole(P.box_sums(blocks(spark, cells), 3, side)) == want).all()


def test_filters_do_not_depend_on_tiles(spark):
    cells = planes(2, 0, 256)
    df = blocks(spark, cells)
    for work in (lambda s: P.separable(df, [1, 2, 1], 2, s), lambda s: P.self_guided(df, 40, s)):
        small, large = whole(work(8)), whole(work(64))
        assert (small == large).all() and small.any()


def test_self_guided_keeps_flat_planes(spark):
    cells = np.full((2, ROWS * 8, COLS * 8), 77)
    got = whole(P.self_guided(blocks(spark, cells), 40, 16))
    assert (got[0, 2:-2, 2:-2] == 77 * 16).all()


def test_overlap_add_without_noise_gives_the_cells_back(spark):
    cells = planes(3, -99, 99)
    df = blocks(spark, cells)
    assert np.allclose(whole(P.overlap_add(df, 0.0, 16), float), cells)
    assert np.abs(whole(P.overlap_add(df, 1e9, 16), float)).max() == 0
    some = [whole(P.overlap_add(df, 5000.0, side), float) for side in (8, 64)]
    assert np.allclose(*some) and 0 < np.abs(some[0]).sum() < np.abs(cells).sum()


def test_strips_are_what_is_shuffled(spark):
    df = blocks(spark, planes(1, 0, 9))
    haloed = P.with_halo(P.tiles_of(df, 64), 64, 2, 2)
    strips = haloed.select(F.explode_outer("strips").alias("x")).agg(F.sum(F.length("x.s")).alias("n")).first()["n"] or 0
    tiles = haloed.count()
    assert strips <= tiles * 8 * (4 * 64 * 2 + 4 * 4) and tiles == 2
    with pytest.raises(ValueError, match="further"):
        P.with_halo(P.tiles_of(df, 8), 8, 9, 0)


def test_empty_planes(spark):
    none = blocks(spark, planes(1, 0, 9)).limit(0)
    assert P.box_sums(none, 1).count() == C.earlier_copies(none, 4).count() == Q.best_partition(none, 2, 5).count() == 0
    assert Y.autoregression(none, 1).count() == 0 and E.exact_quantile(none, F.col("r"), 0.5) is None


@pytest.mark.parametrize(("bits", "side"), [(64, 16), (5, 16), (64, 64)])
def test_copies_at_all_offsets(spark, bits, side):
    cells = planes(5, 0, 2)
    cells[0, 24:32, 40:48] = cells[0, 5:13, 3:11]  # an aligned square that stands at an odd place before
    cells[0, 40:48, 8:16] = 7
    mask, got = there(), {}
    for r in C.earlier_copies(blocks(spark, cells), 8 if bits == 64 else 4, side, bits).collect():
        got[r["frame"], r["y"], r["x"]] = (r["from_y"], r["from_x"])
    size, want = (8 if bits == 64 else 4), {}
    for f in range(2):
        first = {}
        for y in range(ROWS * 8 - size + 1):
            for x in range(COLS * 8 - size + 1):
                square = cells[f, y : y + size, x : x + size]
                if not mask[f, y : y + size, x : x + size].all() or square.min() == square.max():
                    continue
                at = first.setdefault(square.tobytes(), (y, x))
                if y % size == x % size == 0 and at < (y, x):
                    want[f, y, x] = at
    assert got == want and want
    if size == 8:
        assert want[0, 24, 40] == (5, 3)


def test_pyramid_levels_are_made_of_the_ones_below():
    cells = np.random.default_rng(1).integers(0, 3, (1, 40, 40))
    for size in (2, 4, 8):
        hashes, squares = C.pyramid(cells, size)[0], np.lib.stride_tricks.sliding_window_view(cells[0], (size, size))
        by_content = {}
        for y in range(hashes.shape[0]):
            for x in range(hashes.shape[1]):
                assert by_content.setdefault(squares[y, x].tobytes(), hashes[y, x]) == hashes[y, x]
        assert len(set(by_content.values())) == len(by_content)


def test_partition_is_the_cheapest(spark):
    cells, signal = planes(6, 0, 40), 3000
    cells[0, :32, :32] //= 8
    got = Q.best_partition(blocks(spark, cells), 2, signal).collect()
    mask = there()

    def best(f, y, x, side):
        part = cells[f, y : y + side, x : x + side][mask[f, y : y + side, x : x + side]]
        if not part.size:
            return 0, []
        whole_cost = int((part * part).sum()) - int(part.sum()) ** 2 // part.size
        if side == 8:
            return whole_cost, [(f, 0, y // 8, x // 8, whole_cost)]
        halves = [best(f, y + i, x + j, side // 2) for i in (0, side // 2) for j in (0, side // 2)]
        split = sum(c for c, _ in halves) + signal
        if part.size < side * side or split < whole_cost:
            return split, [node for _, nodes in halves for node in nodes]
        level = {16: 1, 32: 2}[side]
        return whole_cost, [(f, level, y // side, x // side, whole_cost)]

    want = [node for f in range(2) for y in range(0, ROWS * 8, 32) for x in range(0, COLS * 8, 32) for node in best(f, y, x, 32)[1]]
    top = {(r["frame"], r["level"], r["r"], r["c"], r["cost"]) for r in got if r["level"] <= 2}
    assert top == set(want) and len(got) == len(want) and {n[1] for n in want} == {0, 1, 2}


def test_rolled_up_sums(spark):
    cells = planes(7, -5, 5)
    levels = Q.rolled_up(blocks(spark, cells), 3)
    assert [df.agg(F.sum("n")).first()[0] for df in levels] == [(2 * ROWS * COLS - len(MISSING)) * 64] * 4
    top = {(r["frame"], r["r"], r["c"]): (r["s"], r["ss"]) for r in levels[3].collect()}
    assert top == {(f, 0, 0): (int(cells[f].sum()), int((cells[f] ** 2).sum())) for f in range(2)}


def test_autoregression_finds_its_coefficients(spark):
    rng, side = np.random.default_rng(8), 48
    cells = np.zeros((2, ROWS * 8, COLS * 8), np.int64)
    for y in range(ROWS * 8):
        for x in range(COLS * 8):
            cells[:, y, x] = np.rint(0.5 * cells[:, y, x - 1] * (x > 0) + 0.3 * cells[:, y - 1, x] * (y > 0) + rng.normal(0, 1000, 2))
    df = blocks(spark, cells)
    fits = {side: {r["frame"]: np.array(r["x"]) for r in Y.solved(Y.autoregression(df, 1, side), ["frame"]).collect()} for side in (8, 64)}
    assert np.allclose(fits[8][0], fits[64][0]) and np.allclose(fits[8][1], fits[64][1])
    assert np.allclose(fits[64][0], [0, 0.3, 0, 0.5], atol=0.06)
    assert len(Y.causal_offsets(3)) == 24


def test_solved(spark):
    rng, rows = np.random.default_rng(9), []
    for n in (0, 1, 5, 24):
        m, x = rng.normal(size=(n, n)), rng.normal(size=n)
        rows.append((n, m.ravel().tolist(), (m @ x).tolist(), x.tolist()))
    df = spark.createDataFrame([*rows, (99, [1.0, 1.0, 1.0, 1.0], [1.0, 2.0], None)], "k int, a array<double>, b array<double>, want array<double>")
    got = {r["k"]: r["x"] for r in Y.solved(df, ["k"]).collect()}
    assert got[99] is None
    for n, _, _, x in rows:
        assert np.allclose(got[n], x)


def test_strength_curve_is_coupled(spark):
    samples = [(1, level, 3 * level + 5) for level in (0, 10, 20, 80, 100)]
    df = spark.createDataFrame(samples, "g int, level long, v long")
    line = Y.strength_curve(df, ["g"], "level", "v", 0, 100, 11, 1e-6).first()["x"]
    assert np.allclose(line, [5 + 30 * i for i in range(11)], atol=0.1)  # places without samples follow their neighbours


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(10)
    values = [*rng.integers(-(2**62), 2**62, 200).tolist(), *[5] * 150, -(2**63), 2**63 - 1, *rng.integers(-9, 9, 100).tolist()]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(7, None)], "g int, v long")
    at = lambda x: sorted(x)[max(1, -(-round(q * len(x) * 10**9) // 10**9)) - 1]
    assert E.exact_quantile(df, F.col("v"), q) == at(values)
    got = {r["g"]: r["v"] for r in E.exact_quantiles(df, ["g"], "v", q).collect()}
    assert got == {g: at(values[g::3]) for g in range(3)}


def test_separable_fit_finds_the_taps(spark):
    degraded = planes(11, -200, 200)
    down, across = [0.5, 0.2, -0.1], [0.8, 0.15, 0.05]
    taps = lambda t: [t[2], t[1], t[0], t[1], t[2]]
    source = np.zeros(degraded.shape)
    for i, a in enumerate(taps(down)):
        for j, b in enumerate(taps(across)):
            source += a * b * np.roll(degraded, (2 - i, 2 - j), (1, 2))
    source = np.rint(source * 1000).astype(np.int64)
    got = {}
    for side in (8, 64):
        moments = Y.window_moments(blocks(spark, source), blocks(spark, degraded), 2, side)
        fits = {r["frame"]: (np.array(r["down"]), np.array(r["across"])) for r in Y.separable_fit(moments, 2, 6).collect()}
        got[side] = fits
        want = np.outer(down, across) * 1000
        assert np.allclose(np.outer(*fits[0]), want, atol=0.5)
    assert all(np.allclose(got[8][f], got[64][f]) for f in (0, 1))
    nothing = Y.window_moments(blocks(spark, source), blocks(spark, degraded * 0), 2)
    assert Y.separable_fit(nothing, 2, 1).first()["down"] is None


def test_transforms_of_all_sizes_come_back(spark):
    assert len(T.SIZES) == 19 and len(T.types_of(16, 4)) == 16 and len(T.types_of(64, 16)) == 1
    for n in T.LENGTHS:
        for kind in T.kinds_of(n):
            assert np.allclose(T.kernel(kind, n) @ T.kernel(kind, n).T, np.eye(n))
    cells, mask = planes(12, -99, 99), there()
    cases = [x for h, w in T.SIZES for x in T.types_of(h, w)[::5]]
    pieces = T.transformed(blocks(spark, cells), cases)
    rows = T.restored(pieces, cases).collect()
    for k, (h, w, *_) in enumerate(cases):
        got = {(r["frame"], r["r"], r["c"]): np.array(r["b"]).reshape(h, w) for r in rows if r["case"] == k}
        want = {(f, y // h, x // w): cells[f, y : y + h, x : x + w] for f in range(2) for y in range(0, ROWS * 8 - h + 1, h) for x in range(0, COLS * 8 - w + 1, w) if mask[f, y : y + h, x : x + w].all()}
        assert got.keys() == want.keys() and all(np.allclose(got[at], want[at]) for at in want)


def test_deblocked_edges(spark):
    """Flat blocks beside each other: small steps become slopes, large ones stay, so does what has no block beside it."""
    cells = np.zeros((2, ROWS * 8, COLS * 8), np.int64) + np.repeat(np.array([100, 104, 108, 200, 204, 100, 101]), 8)
    mask = there()
    cells[~mask] = 0
    results = [whole(P.deblocked(blocks(spark, cells), 10, 40, 4, side)) for side in (8, 16, 64)]
    assert (results[0] == results[1]).all() and (results[1] == results[2]).all()
    got = results[2][0]
    assert (got == got[0]).all()  # level edges have no step
    row = got[0]
    assert row[4:12].tolist() == [100, 101, 101, 102, 103, 103, 104, 104] and row[20:28].tolist() == [108] * 4 + [200] * 4
    assert (results[2][1][:, 24:32][8:] == results[2][0][:, 24:32][8:]).mean() > 0.9 and not results[2][~mask].any()
    rng = np.random.default_rng(13).integers(90, 110, cells.shape)
    noisy = [whole(P.deblocked(blocks(spark, rng * mask), 12, 60, 2, side)) for side in (16, 64)]
    assert (noisy[0] == noisy[1]).all() and (noisy[0] != rng * mask).any()
