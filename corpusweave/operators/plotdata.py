"""The tables behind the figures; any plotting tool can draw them."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.operators.agglomerative import fit_agglomerative
from corpusweave.operators.neighbours import spectral_embedding
from corpusweave.operators.pca import fit_pca
from corpusweave.operators.sampling import sample_n

logger = logging.getLogger(__name__)

SCATTER_METHODS = ("pca", "tsne", "umap")


def _points(df: DataFrame, key: str, cluster: str) -> DataFrame:
    x, y = F.get("_xy", F.lit(0)).alias("x"), F.get("_xy", F.lit(1)).alias("y")
    return df.select(key, x, y, cluster)


def scatter_pca(
    df: DataFrame, vector: str = "vector", cluster: str = "cluster", key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, x, y, cluster)`` on the first two principal components."""
    return _points(fit_pca(df, 2, vector=vector).transform(df, "_xy"), key, cluster)


def scatter_umap(
    df: DataFrame,
    vector: str = "vector",
    cluster: str = "cluster",
    key: str = "doc_id",
    n_neighbors: int = 15,
    seed: int = 42,
) -> DataFrame:
    """``(doc_id, x, y, cluster)`` on the spectral layout of the neighbour graph."""
    layout = spectral_embedding(
        df, 2, n_neighbors=n_neighbors, seed=seed, vector=vector, key=key, output="_xy"
    )
    return _points(layout.join(df.select(key, cluster), key), key, cluster)


def scatter_all(
    df: DataFrame,
    methods: list[str],
    vector: str = "vector",
    cluster: str = "cluster",
    key: str = "doc_id",
) -> DataFrame | None:
    """One table for all methods, told apart by ``method``; t-SNE is skipped with a warning."""
    unknown = [m for m in methods if m.lower() not in SCATTER_METHODS]
    if unknown:
        raise ValueError(f"unknown scatter methods {unknown}; choose from {SCATTER_METHODS}")
    result = None
    for method in (m.lower() for m in methods):
        if method == "tsne":
            logger.warning("t-SNE runs on one machine only and is skipped")
            continue
        draw = scatter_pca if method == "pca" else scatter_umap
        part = draw(df, vector, cluster, key).withColumn("method", F.lit(method))
        result = part if result is None else result.unionByName(part)
    return result


def dendrogram_merges(
    df: DataFrame,
    sample_size: int | None = 300,
    last_p: int = 30,
    vector: str = "vector",
    key: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """``(step, left, right, height, size)``: Ward merges of a sample (None: of all rows), the top
    ``last_p`` leaves; leaves are numbered by key."""
    rows = df.select(key, vector)
    sample = rows if sample_size is None else sample_n(rows, sample_size, key, seed)
    merges = fit_agglomerative(sample, 1, vector=vector, key=key).merges
    return merges.orderBy(F.desc("step")).limit(max(last_p - 1, 0)).orderBy("step")


def size_histogram(sizes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(label, count)`` in ascending cluster order."""
    return sizes.orderBy(cluster).select(
        F.col(cluster).cast("string").alias("label"), F.col("size").alias("count")
    )


def size_share(sizes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(label, percent)`` with one decimal; the window spans one row per cluster."""
    share = 100.0 * F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))
    return sizes.select(
        F.col(cluster).cast("string").alias("label"), F.round(share, 1).alias("percent")
    )
