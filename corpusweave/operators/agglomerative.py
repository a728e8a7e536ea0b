"""Bottom-up clustering: exact merging of all rows, or of the K-Means groups that a caller asks for."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.operators.interpret import centroids
from corpusweave.operators.kmeans import fit_kmeans
from corpusweave.operators.merging import LINKAGES, METRICS, check_linkage, gaps, merge_matrix, merge_rounds, ward_costs
from corpusweave.operators.numbering import number_rows
from corpusweave.session import cut_lineage

__all__ = ["LINKAGES", "METRICS", "AgglomerativeFit", "cut", "fit_agglomerative", "merge_summaries", "summarise"]


def merge_summaries(weights: np.ndarray, centers: np.ndarray, linkage: str = "ward", metric: str = "euclidean") -> np.ndarray:
    """Merge a few weighted centroids in one place: rows of ``(left, right, height, weight)``, see
    :func:`merge_matrix`."""
    check_linkage(linkage, metric)
    centers, weights = np.asarray(centers, dtype=float), np.asarray(weights, dtype=float)
    gap = gaps(centers, centers, metric) if len(weights) else np.zeros((0, 0))
    return merge_matrix(ward_costs(gap, weights, weights) if linkage == "ward" else gap, weights, linkage)


def cut(merges: np.ndarray, m: int, n_clusters: int) -> np.ndarray:
    """Labels 0..n-1 of the m inputs after all but the last ``n_clusters - 1`` merges."""
    parent = np.arange(2 * m - 1 if m else 0)
    for step in range(m - n_clusters):
        left, right = merges[step, :2].astype(int)
        parent[left] = parent[right] = m + step
    root = np.arange(m)
    while (parent[root] != root).any():
        root = parent[root]
    # Clusters are numbered by their first member.
    _, first, code = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[code].astype(int)


@dataclass(frozen=True)
class AgglomerativeFit:
    """Stored labels ``(doc_id, cluster)`` of the fitted rows, and the merges that led to them: ``(step,
    left, right, height, size)`` over rows (or groups) numbered from 0 by key."""

    labels: DataFrame
    merges: DataFrame | None
    n_groups: int

    def predict(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """Attach the stored labels; rows that were not fitted have none."""
        return df.join(self.labels, key)


def summarise(
    df: DataFrame, max_groups: int, *, vector: str = "vector", key: str = "doc_id", seed: int = 42, n_init: int = 10, max_iter: int = 300
) -> tuple[DataFrame, DataFrame]:
    """``(key, group)`` of every row and ``(id, weight, vector)`` of the K-Means groups, at most ``max_groups``."""
    rows = df.select(key, vector)
    fitted = fit_kmeans(rows, max_groups, seed=seed, n_init=n_init, max_iter=max_iter, vector=vector)
    members = cut_lineage(fitted.predict(rows, "group"))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("weight"))
    groups = sizes.join(centroids(members, vector, "group"), "group").select(F.col("group").alias("id"), "weight", F.col("centroid").alias("vector"))
    return members.select(key, "group"), groups


def fit_agglomerative(
    df: DataFrame,
    n_clusters: int,
    *,
    linkage: str = "ward",
    metric: str = "euclidean",
    max_groups: int | None = None,
    n_init: int = 10,
    max_iter: int = 300,
    seed: int = 42,
    vector: str = "vector",
    key: str = "doc_id",
    rest: int | None = None,
) -> AgglomerativeFit:
    """Merge bottom-up to ``n_clusters``, exactly and at every size alike.

    Comparing all rows is quadratic. For very many rows ``max_groups`` puts K-Means groups (``n_init``
    restarts of up to ``max_iter`` steps) in their place, which only fits Ward's linkage: its merges are
    exact for weighted means.
    """
    check_linkage(linkage, metric)
    if max_groups is None:
        # In key order the numbers also say which member of a cluster is its first.
        members = cut_lineage(number_rows(df.select(key, vector), [key], "group"))
        points = members.select(F.col("group").alias("id"), F.lit(1).alias("weight"), vector).withColumnRenamed(vector, "vector")
        members = members.select(key, "group")
    elif linkage != "ward":
        raise ValueError("groups stand for their rows in ward linkage only; leave max_groups out")
    else:
        members, points = summarise(df, max_groups, vector=vector, key=key, seed=seed, n_init=n_init, max_iter=max_iter)
        order = cut_lineage(number_rows(points.select("id"), ["id"], "place"))
        points = points.join(order, "id").select(F.col("place").alias("id"), "weight", "vector")
        members = members.join(F.broadcast(order), members["group"] == order["id"]).select(key, F.col("place").alias("group"))  # max_groups rows
    tree = merge_rounds(points, linkage, metric, rest)
    if not 1 <= n_clusters <= tree.n:
        raise ValueError(f"n_clusters must lie between 1 and {tree.n}")
    labels = tree.cut(0, n_clusters).withColumnRenamed("id", "group")
    return AgglomerativeFit(members.join(labels, "group").select(key, "cluster"), tree.numbered(), tree.n)
