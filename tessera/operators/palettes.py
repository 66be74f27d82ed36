"""k-means of each block's own values, in its row, until it settles: no driver loop, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are worked on together.
ROWS = 1 << 12


def _settled(values: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, steps, squared error) of each row's values, all rows in step, each until nothing changes."""
    low, high = values.min(axis=1)[:, None], values.max(axis=1)[:, None]
    centroids = low + (2 * np.arange(k) + 1) * (high - low) // (2 * k)
    steps, rows = np.zeros(len(values), np.int64), np.arange(len(values))
    for _ in range(most):
        of = np.abs(values[rows][:, :, None] - centroids[rows][:, None, :]).argmin(axis=2)
        mine = of[:, :, None] == np.arange(k)
        n, total = mine.sum(axis=1), (mine * values[rows][:, :, None]).sum(axis=1)
        now = np.where(n > 0, (total + n // 2) // np.maximum(n, 1), centroids[rows])
        steps[rows] += 1
        changed = (now != centroids[rows]).any(axis=1)
        centroids[rows] = now
        rows = rows[changed]
        if not len(rows):
            break
    error = (np.abs(values[:, :, None] - centroids[:, None, :]).min(axis=2) ** 2).sum(axis=1)
    return centroids, steps, error


def block_kmeans(blocks: DataFrame, by: str, sizes: list[int], most: int = 50) -> DataFrame:
    """(by, k, centroids, steps, error): the values of each block (array ``b``, one length) in k clusters, for each of ``sizes``.

    Centroids begin evenly between the least and the greatest value. In each step a value goes to the nearest one, ties to the
    lower place, and centroids become rounded means; an empty one stays. ``most``: steps after which it is stopped.
    """
    kind = dict(blocks.dtypes)[by]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                values = some.column("b").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, -1)
                for k in sizes:
                    centroids, steps, error = _settled(values, k, most)
                    columns = [some.column(by), pa.array(np.full(len(values), k, np.int32)), pa.array(centroids.tolist(), pa.list_(pa.int64())), pa.array(steps), pa.array(error)]
                    yield pa.RecordBatch.from_arrays(columns, [by, "k", "centroids", "steps", "error"])

    return blocks.select(by, "b").mapInArrow(run, f"`{by}` {kind}, k int, centroids array<bigint>, steps bigint, error bigint")
