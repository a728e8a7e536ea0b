"""Covariance and principal components of dense vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.vectors import matrix_of, to_dense, to_ml
from corpusweave.operators.partials import summed

MAX_WIDTH = 4_096  # a d x d covariance must fit on the driver


def mean_vector(df: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray]:
    """Row count and mean of a vector column: n, and d numbers."""
    row = df.select(to_ml(F.col(vector)).alias("v")).agg(
        Summarizer.metrics("count", "mean").summary(F.col("v")).alias("s")
    )
    stats = row.select("s.count", "s.mean").first()
    return stats["count"], stats["mean"].toArray()


def covariance_matrix(df: DataFrame, vector: str = "vector") -> np.ndarray:
    """Sample covariance: means first, then one pass of matrix products on centred rows."""
    n, mean = mean_vector(df, vector)
    width = len(mean)
    if width > MAX_WIDTH:
        raise ValueError(f"{width} dimensions; use truncated SVD for wide or sparse vectors")

    def scatter(batches):
        total = np.zeros((width, width))
        for batch in batches:
            centred = matrix_of(batch.column(0)) - mean
            total += centred.T @ centred
        return {"scatter": total}

    total = summed(df.select(vector), scatter, {"scatter": (width, width)})["scatter"]
    return total / (n - 1)


def covariance(df: DataFrame, vector: str = "vector") -> DataFrame:
    """``(i, j, cov)`` for i <= j."""
    matrix = covariance_matrix(df, vector)
    cells = [
        (i, j, float(matrix[i, j])) for i in range(len(matrix)) for j in range(i, len(matrix))
    ]
    return df.sparkSession.createDataFrame(cells, "i int, j int, cov double")


@dataclass(frozen=True)
class PcaFit:
    """Principal axes of a corpus; :meth:`transform` centres, projects and fixes the signs."""

    model: PCAModel
    mean: np.ndarray
    signs: np.ndarray
    scales: np.ndarray
    vector: str = "vector"

    @property
    def components(self) -> np.ndarray:
        return self.model.pc.toArray().T * self.signs[:, None]

    @property
    def explained_variance_ratio(self) -> np.ndarray:
        return self.model.explainedVariance.toArray()

    def save(self, spark: SparkSession, path: str) -> None:
        """Write Spark's model and what it lacks (mean, signs, scales) below ``path``."""
        self.model.write().overwrite().save(f"{path}/model")
        schema = "mean array<double>, signs array<double>, scales array<double>, vector string"
        row = (self.mean.tolist(), self.signs.tolist(), self.scales.tolist(), self.vector)
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PcaFit:
        mean, signs, scales, vector = spark.read.parquet(f"{path}/values").first()
        return cls(PCAModel.load(f"{path}/model"), np.array(mean), np.array(signs), np.array(scales), vector)

    def transform(self, df: DataFrame, output: str = "reduced") -> DataFrame:
        # Spark's projection does not centre; projecting the mean once and subtracting it does.
        shift = self.model.pc.toArray().T @ self.mean
        factor = self.signs / self.scales
        projected = self.model.transform(df.withColumn("_pca_in", to_ml(F.col(self.vector))))
        corrections = F.array(
            *[
                F.struct(F.lit(float(s)).alias("shift"), F.lit(float(f)).alias("factor"))
                for s, f in zip(shift, factor)
            ]
        )
        centred = F.zip_with(
            to_dense(F.col("_pca_out")), corrections, lambda y, c: (y - c["shift"]) * c["factor"]
        )
        return projected.withColumn(output, centred).drop("_pca_in", "_pca_out")


def fit_pca(
    df: DataFrame, n_components: int, *, whiten: bool = False, vector: str = "vector"
) -> PcaFit:
    """Top principal components; each points so that its largest entry is positive."""
    points = df.select(to_ml(F.col(vector)).alias("_pca_in"))
    n, mean = mean_vector(df, vector)
    if not 1 <= n_components <= min(n, len(mean)):
        raise ValueError(f"n_components must lie between 1 and {min(n, len(mean))}")
    if len(mean) > MAX_WIDTH:
        raise ValueError(f"{len(mean)} dimensions; use truncated SVD for wide or sparse vectors")
    model = PCA(k=n_components, inputCol="_pca_in", outputCol="_pca_out").fit(points)
    axes = model.pc.toArray()
    largest = np.abs(axes).argmax(axis=0)
    signs = np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    scales = np.ones(n_components)
    if whiten:
        variance = np.trace(covariance_matrix(df, vector)) * model.explainedVariance.toArray()
        scales = np.sqrt(np.maximum(variance, np.finfo(float).tiny))
    return PcaFit(model, mean, signs, scales, vector)
