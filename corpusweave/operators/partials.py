"""Sums of NumPy arrays over all rows of a table.

Matrix statistics (Gram matrices, sparse products, mixture moments) have one small array per
partition. Each task adds up its own rows; the per-task pieces are then summed in two shuffled
steps, cut into blocks so that neither step holds more than a square root of all pieces. Small arrays
are summed where the result is wanted, in the order of the tasks, which spares the steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusweave.operators.bounds import task_count

BLOCK_CELLS = 131_072  # 1 MB of doubles
DIRECT_CELLS = 4_000_000  # 32 MB of doubles in the pieces of all tasks

Fold = Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray] | None]

_PIECES = "name string, block int, slot int, part binary"


def summed(df: DataFrame, fold: Fold, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Sum what ``fold`` returns for each partition of ``df``; ``shapes`` bounds the result."""
    tasks = 2 * task_count(df.sparkSession)
    cells = sum(math.prod(shape) for shape in shapes.values())
    direct = cells * min(tasks, df.rdd.getNumPartitions()) <= DIRECT_CELLS
    slots = tasks if direct else max(1, math.isqrt(tasks))

    def run(batches):
        arrays = fold(batches)
        if arrays is None:
            return
        slot = TaskContext.get().partitionId() % slots
        names, blocks, parts = [], [], []
        for name, array in arrays.items():
            flat = np.ascontiguousarray(array, dtype=float).ravel()
            for block, start in enumerate(range(0, flat.size, BLOCK_CELLS)):
                names.append(name)
                blocks.append(block)
                parts.append(flat[start : start + BLOCK_CELLS].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array(blocks, pa.int32()),
                pa.array([slot] * len(names), pa.int32()),
                pa.array(parts, pa.binary()),
            ],
            names=["name", "block", "slot", "part"],
        )

    # Fewer, longer tasks mean fewer pieces: each task streams its rows, so this costs no memory.
    pieces = df.coalesce(tasks).mapInArrow(run, _PIECES)
    if direct:
        flat = {name: np.zeros(math.prod(shape)) for name, shape in shapes.items()}
        for row in sorted(pieces.collect(), key=lambda row: row["slot"]):
            part = np.frombuffer(row["part"])
            start = row["block"] * BLOCK_CELLS
            flat[row["name"]][start : start + part.size] += part
        return {name: flat[name].reshape(shape) for name, shape in shapes.items()}
    if slots > 4:
        pieces = pieces.groupBy("name", "block", "slot").applyInPandas(_add, _PIECES)
    total = pieces.groupBy("name", "block").applyInPandas(_add, _PIECES)
    flat = {name: np.zeros(math.prod(shape)) for name, shape in shapes.items()}
    for row in total.collect():
        part = np.frombuffer(row["part"])
        start = row["block"] * BLOCK_CELLS
        flat[row["name"]][start : start + part.size] = part
    return {name: flat[name].reshape(shape) for name, shape in shapes.items()}


def _add(pieces: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pieces["part"].iloc[0]).copy()
    for part in pieces["part"].iloc[1:]:
        total += np.frombuffer(part)
    return pieces.iloc[:1].assign(part=[total.tobytes()])
