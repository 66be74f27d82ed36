"""Linear systems of n unknowns, one a row, and the normal equations that feed them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planes import KEY, SIDE, stacks, tile_cells, tiles_of, with_halo


def solved(systems: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, x array<double>): the solution of each row's system (a: n x n by rows, b: n); null where it is singular.

    Elimination with pivoting, within the row; rows may differ in n.
    """
    kinds = dict(systems.dtypes)

    def solve(batches):
        for batch in batches:
            found = []
            for m, v in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                try:
                    found.append(np.linalg.solve(np.array(m, float).reshape(len(v), len(v)), np.array(v, float)).tolist() if v else [])
                except np.linalg.LinAlgError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in by), pa.array(found, pa.list_(pa.float64()))], [*by, "x"])

    return systems.select(*by, a, b).mapInArrow(solve, ", ".join(f"`{n}` {kinds[n]}" for n in by) + ", x array<double>")


def causal_offsets(lag: int) -> list[tuple[int, int]]:
    """(dy, dx) of the cells within ``lag`` that come before a cell by rows: 24 for a lag of 3."""
    return [(dy, dx) for dy in range(-lag, 1) for dx in range(-lag, lag + 1) if (dy, dx) < (0, 0)]


SUMS = "frame bigint, m array<bigint>"


def _flat(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A task's sums of each frame."""
    values = pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), values], ["frame", "m"])


def _summed(parts: DataFrame) -> DataFrame:
    """(frame, m): the tasks' sums (``SUMS``) added up, place by place."""
    entries = parts.select("frame", F.posexplode("m").alias("at", "v")).groupBy("frame", "at").agg(F.sum("v").alias("v"))
    return entries.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m")).select("frame", F.col("m")["v"].alias("m"))


def autoregression(blocks: DataFrame, lag: int, side: int = SIDE) -> DataFrame:
    """(frame, n, a, b): the normal equations that predict a cell from those before it, over the cells that have them all.

    Exact sums of products of integers; a task adds up its tiles of a frame, so that a large frame is a row a task.
    """
    offsets = causal_offsets(lag)
    k, no_cell = len(offsets), -(1 << 62)

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for rows, _, cells in stacks(batches, side, lag, lag, no_cell):
            moved = [cells[:, lag + dy : lag + dy + side, lag + dx : lag + dx + side] for dy, dx in [*offsets, (0, 0)]]
            for i, frame in enumerate(rows.column("frame").to_pylist()):
                x = np.stack([m[i].ravel() for m in moved])
                x = x[:, (x != no_cell).all(axis=0)]
                held[frame] = held.get(frame, 0) + np.block([[x @ x.T, np.zeros((k + 1, 1), np.int64)], [np.zeros((1, k + 1), np.int64), np.array([[x.shape[1]]])]])
        yield _flat(held)

    tiles = with_halo(tiles_of(blocks, side), side, lag, lag, no_cell)
    whole = _summed(tiles.mapInArrow(sums, SUMS))
    row = lambda i: F.slice("m", i * (k + 2) + 1, k)
    n = F.element_at("m", (k + 2) ** 2)
    return whole.select("frame", n.alias("n"), F.flatten(F.array(*map(row, range(k)))).alias("a"), row(k).alias("b"))


def window_moments(source: DataFrame, degraded: DataFrame, reach: int, side: int = SIDE) -> DataFrame:
    """(frame, n, h, m): over the cells whose window of ``degraded`` is whole: products of the window's cells with each other
    (h, by rows) and with the cell of ``source`` (m), as exact sums."""
    width, no_cell = (2 * reach + 1) ** 2, -(1 << 62)
    own = tiles_of(source, side).withColumnsRenamed({"slots": "own_slots", "v": "own_v"})
    met = with_halo(tiles_of(degraded, side), side, reach, reach, no_cell).join(own, KEY)

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for rows, _, cells in stacks(batches, side, reach, reach, no_cell):
            wanted = rows.select(["own_slots", "own_v"]).rename_columns(["slots", "v"])
            for i, (frame, (_, y)) in enumerate(zip(rows.column("frame").to_pylist(), tile_cells(wanted, side, no_cell), strict=True)):
                windows = np.lib.stride_tricks.sliding_window_view(cells[i], (2 * reach + 1, 2 * reach + 1)).reshape(side * side, width)
                all_of = np.concatenate([windows, y.reshape(-1, 1), np.ones((side * side, 1), np.int64)], axis=1)
                all_of = all_of[(all_of != no_cell).all(axis=1)]
                held[frame] = held.get(frame, 0) + all_of.T @ all_of
        yield _flat(held)

    whole, k = _summed(met.mapInArrow(sums, SUMS)), width + 2
    row = lambda i, n: F.slice("m", i * k + 1, n)
    return whole.select("frame", F.element_at("m", k * k).alias("n"), F.flatten(F.array(*(row(i, width) for i in range(width)))).alias("h"), row(width, width).alias("m"))


def separable_fit(moments: DataFrame, reach: int, rounds: int) -> DataFrame:
    """(frame, down, across: array<double>): the symmetric taps, from the middle outward, whose product best makes the source
    from the degraded plane: each direction's small system is solved in turn for the other's taps, ``rounds`` times.

    The first round solves for ``down`` with the middle tap alone across. null where a system is singular.
    """
    side = 2 * reach + 1
    fold = np.zeros((side, reach + 1))
    for i in range(side):
        fold[i, abs(i - reach)] = 1

    def fitted(h: np.ndarray, m: np.ndarray) -> tuple[list[float], list[float]] | tuple[None, None]:
        across = np.eye(reach + 1)[0]
        try:
            for _ in range(rounds):
                taps = fold @ across
                down = np.linalg.solve(fold.T @ np.einsum("ijkl,j,l->ik", h, taps, taps) @ fold, fold.T @ (m @ taps))
                taps = fold @ down
                across = np.linalg.solve(fold.T @ np.einsum("ijkl,i,k->jl", h, taps, taps) @ fold, fold.T @ (taps @ m))
        except np.linalg.LinAlgError:
            return None, None
        return down.tolist(), across.tolist()

    def fit(batches):
        for batch in batches:
            found = []
            for h, m in zip(batch.column("h").to_pylist(), batch.column("m").to_pylist(), strict=True):
                found.append(fitted(np.array(h, float).reshape(side, side, side, side), np.array(m, float).reshape(side, side)))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["frame", "down", "across"])

    return moments.select("frame", "h", "m").mapInArrow(fit, "frame bigint, down array<double>, across array<double>")


def strength_curve(samples: DataFrame, by: list[str], level: str, value: str, low: int, high: int, bins: int, smooth: float) -> DataFrame:
    """(by, x array<double>): a value at each of ``bins`` even places from ``low`` to ``high``, so that the lines between them
    fit the samples: bins are coupled by the samples between them and by ``smooth`` times the difference of neighbours.

    Sums of products are exact: a level's distance from its bin is counted in (high - low) parts. A group is one
    tridiagonal system, solved within its row; its 2 bins sums are what is shuffled.
    """
    span, steps = high - low, bins - 1
    at = (F.least(F.greatest(F.col(level), F.lit(low)), F.lit(high)) - low).cast("bigint") * steps
    i = F.least(F.floor(at / span), F.lit(steps - 1))
    rows = samples.select(*by, i.cast("int").alias("i"), (at - i * span).alias("f"), F.col(value).cast("bigint").alias("v"))
    w0, w1 = F.lit(span) - F.col("f"), F.col("f")
    exact = lambda x: F.sum(x.cast("decimal(38,0)")).cast("double")
    sums = rows.groupBy(*by, "i").agg(exact(w0 * w0).alias("m00"), exact(w0 * w1).alias("m01"), exact(w1 * w1).alias("m11"), exact(w0 * F.col("v")).alias("b0"), exact(w1 * F.col("v")).alias("b1"))
    groups = sums.groupBy(*by).agg(F.collect_list(F.struct("i", "m00", "m01", "m11", "b0", "b1")).alias("parts"))
    kinds = dict(groups.dtypes)

    def systems(batches):
        for batch in batches:
            a, b = [], []
            for parts in batch.column("parts").to_pylist():
                m, v = np.zeros((bins, bins)), np.zeros(bins)
                for p in sorted(parts, key=lambda p: p["i"]):
                    k = p["i"]
                    m[k : k + 2, k : k + 2] += np.array([[p["m00"], p["m01"]], [p["m01"], p["m11"]]]) / span**2
                    v[k : k + 2] += np.array([p["b0"], p["b1"]]) / span
                for k in range(steps):
                    m[k : k + 2, k : k + 2] += smooth * np.array([[1, -1], [-1, 1]])
                a.append(m.ravel().tolist())
                b.append(v.tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in by), pa.array(a, kind), pa.array(b, kind)], [*by, "a", "b"])

    made = groups.mapInArrow(systems, ", ".join(f"`{n}` {kinds[n]}" for n in by) + ", a array<double>, b array<double>")
    return solved(made, by)
