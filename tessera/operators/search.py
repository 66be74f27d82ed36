"""Staged search: where a block of one plane stands in another, from coarse to fine steps.

Tiles of the searched planes, with the cells around them, meet the blocks of the same place by one join. A fixed number of
stages follows within the row: each tries the nine sites around the last one's best, at half its step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planes import KEY, N, SIDE, _lists, stacks, tiles_of, with_halo


def sites(step: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in (-step, 0, step) for dx in (-step, 0, step)]


def _differences(windows: np.ndarray, blocks: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.abs(windows[y, x] - blocks).sum(axis=(1, 2))


def staged_search(blocks: DataFrame, searched: DataFrame, steps: list[int], side: int = SIDE) -> DataFrame:
    """(frame, r, c, dy, dx, sad, best_sad): of each block the place found in ``searched``, and the least sum of absolute
    differences of all places within reach. Sites go by dy, then dx; the first of the least is taken, the last best one before others.

    Steps halve; cells that ``searched`` has no block for are 0; blocks of a tile that it lacks are left out.
    """
    reach, a = sum(steps), side // N
    own = tiles_of(blocks, side).withColumnsRenamed({"slots": "own_slots", "v": "own_v"})
    met = with_halo(tiles_of(searched, side), side, reach, reach).join(own, KEY)

    def run(batches):
        for rows, _, cells in stacks(batches, side, reach, reach, 0):
            out: list[list[np.ndarray]] = []
            for i, (slots, v) in enumerate(zip(_lists(rows.column("own_slots")), _lists(rows.column("own_v")), strict=True)):
                windows = np.lib.stride_tricks.sliding_window_view(cells[i], (N, N))
                b, y0, x0 = v.reshape(-1, N, N), slots // a * N + reach, slots % a * N + reach
                dy, dx = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                least = _differences(windows, b, y0, x0)
                for step in steps:
                    cy, cx = dy.copy(), dx.copy()
                    for sy, sx in sites(step):
                        d = _differences(windows, b, y0 + cy + sy, x0 + cx + sx)
                        better = d < least
                        least[better], dy[better], dx[better] = d[better], (cy + sy)[better], (cx + sx)[better]
                best = least.copy()
                for sy in range(-reach, reach + 1):
                    for sx in range(-reach, reach + 1):
                        best = np.minimum(best, _differences(windows, b, y0 + sy, x0 + sx))
                frame, tr, tc = (rows.column(n)[i].as_py() for n in KEY)
                out.append([np.full(len(b), frame), tr * a + slots // a, tc * a + slots % a, dy, dx, least, best])
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["frame", "r", "c", "dy", "dx", "sad", "best_sad"])

    return met.mapInArrow(run, "frame bigint, r bigint, c bigint, dy bigint, dx bigint, sad bigint, best_sad bigint")


def displaced(blocks: DataFrame, frames: int) -> DataFrame:
    """The blocks as those of ``frames`` frames later."""
    return blocks.withColumn("frame", F.col("frame") + frames)
