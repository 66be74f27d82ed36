"""Two-dimensional transforms of a plane's pieces in all sizes, forward and back.

A piece of h x w cells, 4 to 64 each way, is transformed by one kernel down and one across. Tiles hold whole pieces of all sizes,
so one shuffle into tiles serves any number of sizes and kernels; pieces that no block fills wholly are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .planes import KEY, SIDE, cosines, tile_cells, tiles_of

LENGTHS = (4, 8, 16, 32, 64)
#: Heights and widths that differ by a factor of 4 at most.
SIZES = [(h, w) for h in LENGTHS for w in LENGTHS if max(h, w) <= 4 * min(h, w)]
KINDS = ("cosine", "sine", "flipped", "identity")
NO_CELL = -(1 << 62)


class Case(NamedTuple):
    height: int
    width: int
    down: str
    across: str


def kernel(kind: str, n: int) -> np.ndarray:
    """A kernel of n values by rows; all but the Hadamard one are orthonormal."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == "cosine":
        return cosines(n)
    if kind in ("sine", "flipped"):
        sine = 2 / np.sqrt(2 * n + 1) * np.sin(np.pi * (2 * k + 1) * (i + 1) / (2 * n + 1)) if n == 4 else np.sqrt(2 / n) * np.sin(np.pi * (2 * k + 1) * (2 * i + 1) / (4 * n))
        return sine[:, ::-1] if kind == "flipped" else sine
    if kind == "hadamard":
        return 1.0 - 2 * (np.bitwise_count(k & i) % 2)
    return np.eye(n)


def kinds_of(n: int) -> tuple[str, ...]:
    """Kernels in use at a length: all up to 16, two at 32, one at 64."""
    return KINDS if n <= 16 else ("cosine", "identity") if n == 32 else ("cosine",)


def types_of(height: int, width: int) -> list[Case]:
    """The pairs of kernels in use for a size: those in use for the longer side, either way."""
    kinds = kinds_of(max(height, width))
    return [Case(height, width, down, across) for down in kinds for across in kinds]


def transformed(blocks: DataFrame, cases: list[Case]) -> DataFrame:
    """(frame, case, r, c, t array<double>): coefficients by rows of the piece at place (r, c) of its size, for each of ``cases``."""
    kernels = [(kernel(x.down, x.height), kernel(x.across, x.width)) for x in cases]

    def run(batches):
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in KEY), strict=True)
            for (frame, tr, tc), (_, cells) in zip(keys, tile_cells(batch, SIDE, NO_CELL), strict=True):
                for case, ((h, w, *_), (down, across)) in enumerate(zip(cases, kernels, strict=True)):
                    pieces = cells.reshape(SIDE // h, h, SIDE // w, w).swapaxes(1, 2)
                    r, c = np.nonzero((pieces != NO_CELL).all(axis=(2, 3)))
                    t = down @ pieces[r, c].astype(np.float64) @ across.T
                    offsets = pa.array(np.arange(len(r) + 1, dtype=np.int32) * h * w)
                    columns = [np.full(len(r), frame), np.full(len(r), case, np.int32), tr * (SIDE // h) + r, tc * (SIDE // w) + c]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pa.array(t.ravel()))], ["frame", "case", "r", "c", "t"])

    return tiles_of(blocks).mapInArrow(run, "frame bigint, case int, r bigint, c bigint, t array<double>")


def restored(pieces: DataFrame, cases: list[Case]) -> DataFrame:
    """``transformed`` undone: (frame, case, r, c, b array<double>), the cells by rows. Of orthonormal kernels."""
    kernels = [(kernel(x.down, x.height), kernel(x.across, x.width)) for x in cases]

    def run(batches):
        for batch in batches:
            case, t = batch.column("case").to_numpy(), batch.column("t").to_pylist()
            cells = [(kernels[k][0].T @ np.array(x).reshape(cases[k][:2]) @ kernels[k][1]).ravel().tolist() for k, x in zip(case.tolist(), t, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("frame", "case", "r", "c")), pa.array(cells, pa.list_(pa.float64()))], ["frame", "case", "r", "c", "b"])

    return pieces.select("frame", "case", "r", "c", "t").mapInArrow(run, "frame bigint, case int, r bigint, c bigint, b array<double>")
