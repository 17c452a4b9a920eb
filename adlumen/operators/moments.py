"""Centred moments of all pairs of columns in one buffer, merged without loss of digits.

For columns i and j, over the rows where both are known: the number of rows, the mean of i, the sum of squares of i
around that mean, and the sum of products around both means. Four square matrices hold them for all pairs. Two
buffers merge by the shift of their means, so a mean of a billion beside a deviation of one costs nothing, and the
buffers of tasks can meet in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUFFER = "moments array<double>"
#: Buffers of tasks meet in this many tasks before the last one, so that neither level is long.
MERGERS = 64
#: A sum of squares below this part of what it was subtracted from is rounding.
NO_DIGITS = 1e-13


def batch_moments(values: np.ndarray) -> np.ndarray:
    """Buffer (4, k, k) of a batch of rows; NaN stands for a null.

    Shifted by the first value, then by the mean of what that leaves: a constant column gives zeros exactly.
    """
    known = ~np.isnan(values)
    first = np.nan_to_num(values[np.argmax(known, axis=0), np.arange(values.shape[1])])
    shifted = np.where(known, values - first, 0.0)
    mean = shifted.sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    centre, shifted = first + mean, np.where(known, shifted - mean, 0.0)
    mask = known.astype(np.float64)
    n = mask.T @ mask
    offset = (shifted.T @ mask) / np.maximum(n, 1.0)  # of the mean over the pair's rows from the batch's own
    raw = (shifted ** 2).T @ mask
    squares = raw - n * offset ** 2
    squares = np.where(squares > NO_DIGITS * raw, squares, 0.0)
    products = shifted.T @ shifted - n * offset * offset.T
    return np.stack([n, centre[:, None] + offset, squares, products])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buffer of the rows of both."""
    n = a[0] + b[0]
    part = b[0] / np.maximum(n, 1.0)
    step = b[1] - a[1]
    mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + step * part))
    cross = np.where((a[0] > 0) & (b[0] > 0), a[0] * part, 0.0)
    return np.stack([n, mean, a[2] + b[2] + cross * step ** 2, a[3] + b[3] + cross * step * step.T])


def correlation(moments: np.ndarray) -> np.ndarray:
    """Matrix of correlations; NaN where a side is constant or has no rows."""
    squares = np.maximum(moments[2], 0.0)
    spread = np.sqrt(squares) * np.sqrt(squares.T)
    r = np.divide(moments[3], spread, out=np.full_like(spread, np.nan), where=spread > 0)
    np.fill_diagonal(r, np.where(np.diag(spread) > 0, 1.0, np.nan))
    return r


def _one_buffer(buffers: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for buffer in buffers:
        total = buffer if total is None else merged(total, buffer)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["moments"])


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """At most one row with ``moments``, the buffer of the double columns; no row if ``df`` is empty."""
    k = len(columns)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _one_buffer(
            batch_moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64))
            for batch in batches if batch.num_rows)

    def of_buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _one_buffer(
            row.reshape(4, k, k) for batch in batches if batch.num_rows
            for row in batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))

    level = df.select(*columns).mapInArrow(of_rows, BUFFER)
    # Dealt by the buffer's own content, which a repeated task makes again.
    spread = level.repartition(MERGERS, F.xxhash64("moments")).mapInArrow(of_buffers, BUFFER)
    return spread.repartition(1).mapInArrow(of_buffers, BUFFER)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, r)`` for every ordered pair of the double columns; all null if ``df`` is empty. NaN counts as null."""
    names, k = list(columns), len(columns)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.full((k, k), np.nan)
        for batch in batches:
            for row in batch.column(0).drop_null().to_pylist():
                found = correlation(np.array(row).reshape(4, k, k))
        flat = found.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, k).tolist()), pa.array(names * k), pa.array(flat, mask=np.isnan(flat))],
            names=["col_a", "col_b", "r"])

    one_row = moments(df, names).agg(F.first("moments").alias("moments"))
    return one_row.mapInArrow(cells, "col_a string, col_b string, r double")
