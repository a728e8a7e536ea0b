"""Comparing every row with every other row, block against block.

Rows are hashed by key into blocks of a bounded size. Each task holds two blocks, compares them as
matrices, and returns only what is asked for (sums, or the k nearest), never the pairs themselves.
The work still grows with the square of the rows: callers bound it by a sample or by choice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.vectors import matrix_of
from corpusweave.operators.bounds import task_count

BLOCK_ROWS = 1_000
BLOCK_CELLS = 1_000_000  # numbers in one side of a task that looks for nearest rows
TILE = (512, 4_096)  # rows of the two sides that it multiplies at a time
FIRST = 1_024  # rows of the second side among which the first bounds are found
FEW = 64  # pairs of a row and a tile that may be compared without bounds in doubles
PAIRS = 16_384  # pairs whose differences are computed at a time


def blocks_for(rows: int) -> int:
    return max(1, math.ceil(rows / BLOCK_ROWS))


def search_blocks(spark: SparkSession, rows: int, width: int) -> int:
    """How many blocks :func:`nearest_rows` is to work on. Every row travels to all of them, so they are as
    few as the cells of one and the cores to be kept busy allow."""
    fewest = math.ceil(rows * max(1, width) / BLOCK_CELLS)
    return max(1, min(blocks_for(rows), max(fewest, math.ceil(math.sqrt(4 * task_count(spark))))))


def compare_blocks(
    rows: DataFrame,
    key: str,
    n_blocks: int,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left: DataFrame | None = None,
) -> DataFrame:
    """Run ``compare(left_block, right_block)`` for every ordered pair of blocks, the left ones taken from
    ``left`` if it is given."""
    tasks = min(n_blocks * n_blocks, 4 * task_count(rows.sparkSession))
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = (rows if left is None else left).withColumn("_left", block).withColumn("_right", every)
    right = rows.withColumn("_right", block).withColumn("_left", every)

    def grouped(side: DataFrame):
        # Fresh aliases keep the two sides apart, as both come from the same table.
        side = side.select(*[F.col(c).alias(c) for c in side.columns])
        return side.repartition(tasks, "_left", "_right").groupBy("_left", "_right")

    return grouped(left).cogroup(grouped(right)).applyInArrow(compare, schema)


def distances(left: pa.Table, right: pa.Table, vector: str) -> np.ndarray:
    """Euclidean distances from coordinate differences, so equal rows are exactly 0 apart."""
    a = matrix_of(left[vector].combine_chunks())
    b = matrix_of(right[vector].combine_chunks())
    squared = np.zeros((len(a), len(b)))
    for column in range(a.shape[1]):
        squared += np.square(a[:, column, None] - b[None, :, column])
    return np.sqrt(squared)


class _Bounds:
    """Numbers below the squared distances of all rows of two sides: a matrix product, less its rounding.

    Both sides are moved to the middle of the second and scaled by a power of two first, so that numbers of any
    ``kind`` hold them. With ``sizes`` of both sides a row has a limit for the Ward height instead: a height
    ``2 l r / (l + r) d <= h`` is ``d - h / 2r <= h / 2l``, so the limit is one more column of the product.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray] | None, kind: type):
        width, limits = a.shape[1], np.finfo(kind)
        self.rounding, self.sizes, self.kind, self.scale = 4 * (width + 8) * float(limits.eps), sizes, kind, 1.0
        middle = np.zeros(width)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(2):  # to the numbers' size, then to that of their differences
                a, b = a - middle, b - middle
                top = max((np.abs(x).max(initial=0.0, where=np.isfinite(x)) for x in (a, b)), default=0.0)
                scale = 2.0 ** -float(np.clip(np.frexp(top)[1], -1_000, 1_000))
                a, b, self.scale = a * scale, b * scale, self.scale * scale
                whole = np.isfinite(b).all(axis=1)
                middle = b[whole].mean(axis=0) if whole.any() else np.zeros(width)
            a, b = a.astype(kind), b.astype(kind)
            self.least = 4 * (width + 8) * float(limits.tiny)
            a_low, b_low = ((1 - self.rounding) * np.square(x).sum(axis=1) - self.least for x in (a, b))
        share = np.zeros(len(b)) if sizes is None else 1.0 / sizes[1]
        self.left = np.column_stack([-2.0 * a, a_low, np.ones(len(a)), np.zeros(len(a))]).astype(kind)
        self.right = np.vstack([b.T, np.ones(len(b)), b_low, share]).astype(kind)

    def first(self, rows: slice, stop: int) -> np.ndarray:
        """About the values of the first columns, up to a factor."""
        with np.errstate(over="ignore", invalid="ignore"):
            low = self.left[rows] @ self.right[:, :stop]
            if self.sizes is not None:
                left, right = self.sizes[0][rows, None].astype(self.kind), self.sizes[1][None, :stop].astype(self.kind)
                low *= left * right / (left + right)
        return low

    def within(self, rows: np.ndarray, columns: slice, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and ``columns`` of all pairs whose value may be at most the row's ``bound``."""
        with np.errstate(over="ignore", invalid="ignore"):
            limit = bound * self.scale * self.scale * (1 + self.rounding)
            left = self.left[rows]
            if self.sizes is not None:
                left[:, -1] = limit / -2
                limit = limit / (2 * self.sizes[0][rows])
            limit = (limit + self.least).astype(self.kind)
            low = left @ self.right[:, columns]
            hit = np.flatnonzero(~(low.min(axis=1) > limit))  # most rows have none in most tiles
            if 2 * len(hit) > len(rows):
                hit, near = np.arange(len(rows)), ~(low > limit[:, None])
            else:
                near = ~(low[hit] > limit[hit, None])
        row, column = np.divmod(np.flatnonzero(near), max(1, near.shape[1]))
        return hit[row], column


def nearest_rows(
    a: np.ndarray, b: np.ndarray, k: int, a_ids: np.ndarray, b_ids: np.ndarray | None, sizes: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, value)``: the k nearest rows of ``b`` for each row of ``a``, nearest first, ties by place
    in ``b``; rows of an equal id are left out unless ``b_ids`` is None.

    The value is the Euclidean distance, or with ``sizes`` of both sides the squared Ward height. Matrix
    products in single numbers give bounds below all values; where these let too many pairs through, as
    near groups far from the middle do, they are made again in doubles. Values themselves are computed from
    coordinate differences, but only where the bound is not above the k-th value found so far.
    """
    rounding = 4 * (a.shape[1] + 8) * np.finfo(float).eps
    spare = 0 if b_ids is None else int(np.unique(b_ids, return_counts=True)[1].max(initial=0))
    coarse, fine = _Bounds(a, b, sizes, np.float32), None

    def values(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        found = np.empty(len(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(rows), PAIRS):
                some = slice(at, at + PAIRS)
                gap = np.square(a[rows[some]] - b[columns[some]])
                # coordinate after coordinate, as NumPy adds up all but a single column
                gap = np.ascontiguousarray((gap if len(gap) > 1 else np.repeat(gap, 2, axis=0)).T)
                found[some] = np.sqrt(np.add.reduce(gap, axis=0))[: len(rows) - at]
            if sizes is not None:
                left, right = sizes[0][rows], sizes[1][columns]
                found = np.square(found) * (2.0 * (left * right) / (left + right))
        return np.where(a_ids[rows] == b_ids[columns], np.inf, found) if b_ids is not None else found

    parts = []
    for top in range(0, len(a), TILE[0]):
        n = min(TILE[0], len(a) - top)
        own = np.arange(top, top + n)
        bound = np.full(n, np.inf)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for start in range(0, len(b), TILE[1]):
            stop = min(start + TILE[1], len(b))
            if not start:
                some = min(stop, max(FIRST, 4 * (k + spare)))
                picks = min(k + spare, some)
                pick = np.argpartition(coarse.first(slice(top, top + n), some), picks - 1, axis=1)[:, :picks]
                tried = np.sort(values(np.repeat(own, picks), pick.ravel()).reshape(n, picks), axis=1)
                if picks >= k:
                    bound = _loosened(tried[:, k - 1], sizes is None, rounding)
            rows, columns = coarse.within(own, slice(start, stop), bound)
            if len(rows) > (FEW + 8 * k) * n:
                fine = fine or _Bounds(a, b, sizes, np.float64)
                rows, columns = fine.within(own, slice(start, stop), bound)
            value = values(rows + top, columns + start)
            kept = np.isfinite(value)
            if not kept.any():
                continue
            rows, columns, value = (np.concatenate(x) for x in zip(best, (rows[kept], columns[kept] + start, value[kept]), strict=True))
            order = np.lexsort((columns, value, rows))
            rows, columns, value = rows[order], columns[order], value[order]
            first = np.searchsorted(rows, np.arange(n))
            place = np.arange(len(rows)) - first[rows]
            bound[rows[place == k - 1]] = _loosened(value[place == k - 1], sizes is None, rounding)
            best = tuple(x[place < k] for x in (rows, columns, value))
        parts.append((best[0] + top, *best[1:]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _loosened(value: np.ndarray, squared: bool, rounding: float) -> np.ndarray:
    """A value as a bound on squares: what rounds to the same value is not above it."""
    bound = np.where(np.isnan(value), np.inf, value)
    return (np.square(bound) if squared else bound) * (1 + rounding) + np.finfo(float).tiny
