"""Gaussian mixtures by distributed EM.

Spark ML has full covariances only and no floor under them, so it stops with an error where copies
of a text make a component flat. Here every kind shares one pass per iteration: tasks score their
rows as matrices and return moments whose size does not depend on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.vectors import list_column, matrix_of
from corpusweave.operators.kmeans import fit_kmeans
from corpusweave.operators.partials import summed

COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
REG_COVAR = 1e-6


@dataclass(frozen=True)
class Mixture:
    """Parameters of a mixture of k Gaussians in d dimensions.

    ``covariances`` is (k, d, d) for full, (d, d) for tied, (k, d) for diag and (k,) for spherical.
    """

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    covariance_type: str

    def log_joint(self, points: np.ndarray) -> np.ndarray:
        """Log of weight times density, a row per point and a column per component."""
        k, d = self.means.shape
        out = np.empty((len(points), k))
        for j in range(k):
            centred = points - self.means[j]
            if self.covariance_type in ("full", "tied"):
                matrix = self.covariances if self.covariance_type == "tied" else self.covariances[j]
                root = np.linalg.cholesky(matrix)
                scaled = np.linalg.solve(root, centred.T).T
                log_det = 2.0 * np.log(np.diag(root)).sum()
            else:
                variance = np.broadcast_to(self.covariances[j], (d,))
                scaled = centred / np.sqrt(variance)
                log_det = np.log(variance).sum()
            out[:, j] = -0.5 * (np.square(scaled).sum(axis=1) + log_det + d * math.log(2 * math.pi))
        return out + np.log(self.weights)

    def n_parameters(self) -> int:
        k, d = self.means.shape
        spread = {
            "full": k * d * (d + 1) // 2,
            "tied": d * (d + 1) // 2,
            "diag": k * d,
            "spherical": k,
        }[self.covariance_type]
        return spread + k * d + k - 1


def _normalised(log_joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = log_joint.max(axis=1, keepdims=True)
    shares = np.exp(log_joint - top)
    total = shares.sum(axis=1, keepdims=True)
    return shares / total, (top + np.log(total)).ravel()


@dataclass(frozen=True)
class GmmFit:
    mixture: Mixture
    log_likelihoods: tuple[float, ...]
    vector: str = "vector"

    def predict(self, df: DataFrame, output: str = "cluster", probability: str = "probability") -> DataFrame:
        """Add the most likely component and the membership probabilities."""
        mixture = self.mixture

        @F.arrow_udf("array<double>")
        def memberships(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return list_column(np.empty((0, len(mixture.weights))))
            return list_column(_normalised(mixture.log_joint(matrix_of(vectors)))[0])

        scored = df.withColumn(probability, memberships(F.col(self.vector)))
        best = F.array_position(probability, F.array_max(probability)) - 1
        return scored.withColumn(output, best.cast("int"))

    def predict_proba(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(doc_id, component, probability)``."""
        return self.predict(df).select(key, F.posexplode("probability").alias("component", "probability"))

    def log_likelihood(self, df: DataFrame) -> tuple[int, float]:
        """Row count and total log-likelihood under the fitted parameters."""
        mixture = self.mixture

        @F.arrow_udf("double")
        def score(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.float64())
            return pa.array(_normalised(mixture.log_joint(matrix_of(vectors)))[1])

        row = df.agg(F.count(F.lit(1)), F.sum(score(F.col(self.vector)))).first()
        return row[0], row[1]

    def bic(self, df: DataFrame) -> DataFrame:
        n, total = self.log_likelihood(df)
        value = -2.0 * total + self.mixture.n_parameters() * math.log(n)
        return df.sparkSession.createDataFrame([(value,)], "bic double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write one row per component."""
        m = self.mixture
        k, d = m.means.shape
        spreads = np.broadcast_to(m.covariances, (k, d, d)) if m.covariance_type == "tied" else m.covariances
        rows = [
            (j, float(m.weights[j]), m.means[j].tolist(), np.ravel(spreads[j]).tolist(), m.covariance_type, self.vector)
            for j in range(k)
        ]
        schema = "component int, weight double, mean array<double>, covariance array<double>, covariance_type string, vector string"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GmmFit:
        rows = spark.read.parquet(path).orderBy("component").collect()  # k rows
        kind = rows[0]["covariance_type"]
        means = np.array([r["mean"] for r in rows])
        k, d = means.shape
        spreads = np.array([r["covariance"] for r in rows])
        if kind == "full":
            spreads = spreads.reshape(k, d, d)
        elif kind == "tied":
            spreads = spreads[0].reshape(d, d)
        elif kind == "spherical":
            spreads = spreads.ravel()
        mixture = Mixture(np.array([r["weight"] for r in rows]), means, spreads, kind)
        return cls(mixture, (), rows[0]["vector"])


def _estimate(stats: dict[str, np.ndarray], origin: np.ndarray, kind: str) -> Mixture:
    """M-step: parameters from responsibilities and moments about each component's origin."""
    mass = stats["mass"] + 10 * np.finfo(float).eps
    shift = stats["first"] / mass[:, None]
    width = origin.shape[1]
    if kind == "tied":
        spread = (stats["second"] - (shift * mass[:, None]).T @ shift) / mass.sum()
        spread = spread + REG_COVAR * np.eye(width)
    elif kind == "full":
        outer = shift[:, :, None] * shift[:, None, :]
        spread = stats["second"] / mass[:, None, None] - outer + REG_COVAR * np.eye(width)
    else:
        spread = np.maximum(stats["second"] / mass[:, None] - np.square(shift), 0.0) + REG_COVAR
        if kind == "spherical":
            spread = spread.mean(axis=1)
    return Mixture(mass / mass.sum(), origin + shift, spread, kind)


def _moments(
    df: DataFrame, kind: str, origin: np.ndarray, share: Callable
) -> dict[str, np.ndarray]:
    """Sum responsibilities and moments; ``share(batch)`` gives points, shares and log-likelihoods.

    Moments are taken about ``origin`` (k x d), which lies near the means, so that little is lost
    when squares are subtracted.
    """
    k, d = origin.shape
    second_shape = {"full": (k, d, d), "tied": (d, d)}.get(kind, (k, d))

    def fold(batches):
        mass, first, second = np.zeros(k), np.zeros((k, d)), np.zeros(second_shape)
        likelihood = np.zeros(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, shares, log_p = share(batch)
            mass += shares.sum(axis=0)
            likelihood += log_p.sum()
            for j in range(k):
                centred = points - origin[j]
                weighed = centred * shares[:, j, None]
                first[j] += weighed.sum(axis=0)
                if kind == "full":
                    second[j] += weighed.T @ centred
                elif kind == "tied":
                    second += weighed.T @ centred
                else:
                    second[j] += (weighed * centred).sum(axis=0)
        return {"mass": mass, "first": first, "second": second, "likelihood": likelihood}

    shapes = {"mass": (k,), "first": (k, d), "second": second_shape, "likelihood": (1,)}
    return summed(df, fold, shapes)


def mixture_from_labels(
    df: DataFrame,
    origin: np.ndarray,
    kind: str = "diag",
    vector: str = "vector",
    cluster: str = "cluster",
) -> Mixture:
    """M-step from hard labels 0..k-1; ``origin`` holds rough centres (or zeros), k x d."""
    k = len(origin)

    def share(batch):
        points = matrix_of(batch.column(0))
        shares = np.zeros((len(points), k))
        shares[np.arange(len(points)), batch.column(1).to_numpy(zero_copy_only=False)] = 1.0
        return points, shares, np.zeros(len(points))

    return _estimate(_moments(df.select(vector, cluster), kind, origin, share), origin, kind)


def em_step(df: DataFrame, mixture: Mixture, vector: str = "vector") -> tuple[Mixture, float, int]:
    """One pass over the rows: new parameters, and the old ones' log-likelihood and row count."""

    def share(batch):
        points = matrix_of(batch.column(0))
        return (points, *_normalised(mixture.log_joint(points)))

    stats = _moments(df.select(vector), mixture.covariance_type, mixture.means, share)
    return (
        _estimate(stats, mixture.means, mixture.covariance_type),
        float(stats["likelihood"][0]),
        round(float(stats["mass"].sum())),
    )


def fit_gmm(
    df: DataFrame,
    n_clusters: int,
    *,
    covariance_type: str = "full",
    max_iter: int = 100,
    tol: float = 1e-3,
    seed: int = 42,
    vector: str = "vector",
) -> GmmFit:
    """Fit by EM until the mean log-likelihood gains less than ``tol``."""
    if covariance_type not in COVARIANCE_TYPES:
        raise ValueError(f"covariance_type must be one of {COVARIANCE_TYPES}")
    points = df.select(vector).persist()
    try:
        start = fit_kmeans(points, n_clusters, seed=seed, n_init=1, vector=vector)
        labelled = start.predict(points)
        mixture = mixture_from_labels(labelled, start.cluster_centers, covariance_type, vector)
        seen: list[float] = []
        for _ in range(max_iter):
            improved, total, n = em_step(points, mixture, vector)
            seen.append(total)
            if len(seen) > 1 and abs(seen[-1] - seen[-2]) / n < tol:
                break
            mixture = improved
        return GmmFit(mixture, tuple(seen), vector)
    finally:
        points.unpersist()

