"""Vector arithmetic on ``array<double>`` columns, and the step to and from ML vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def to_dense(vector: Column) -> Column:
    """A sparse or dense ML vector as ``array<double>``."""
    return vector_to_array(vector)


def to_ml(vector: Column) -> Column:
    return array_to_vector(vector)


def squared_distance(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda total, part: total + part,
    )


def distance(left: Column, right: Column) -> Column:
    return F.sqrt(squared_distance(left, right))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal-length rows as a 2-D array."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def list_column(matrix: np.ndarray) -> pa.Array:
    """A 2-D array as an Arrow ``list<double>`` column."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))
