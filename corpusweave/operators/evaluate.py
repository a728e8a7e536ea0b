"""Scores of a clustering, as one-row tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.vectors import distance, to_ml
from corpusweave.operators.blocks import blocks_for, compare_blocks, distances
from corpusweave.operators.bounds import per_cluster_join
from corpusweave.operators.interpret import centroids
from corpusweave.operators.sampling import sample_n
from corpusweave.session import cut_lineage

NEAR_ZERO = 1e-8


@dataclass(frozen=True)
class EvaluationConfig:
    compute_silhouette: bool = True
    compute_davies_bouldin: bool = True
    silhouette_sample_size: int | None = 5_000
    seed: int = 42


def n_clusters_found(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Distinct labels; -1 marks noise and is not counted."""
    found = F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster)))
    return df.agg(found.alias("n_clusters_found"))


def n_samples(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_samples"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def silhouette(
    df: DataFrame,
    vector: str = "vector",
    cluster: str = "cluster",
    key: str = "doc_id",
    sample_size: int | None = 5_000,
    seed: int = 42,
) -> DataFrame:
    """Mean silhouette with Euclidean distance, on an exact-size sample or (None) on all rows.

    Null unless there are at least two clusters and fewer clusters than rows.
    """
    rows = df.select(
        F.col(key).alias("id"), F.col(cluster).alias("own"), F.col(vector).alias("vector")
    )
    if sample_size is None:
        n_blocks = blocks_for(rows.count())
    else:
        rows = sample_n(rows, sample_size, "id", seed)
        n_blocks = blocks_for(sample_size)

    def distance_sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SUMS.empty_table()
        gaps = distances(left, right, "vector")
        labels, code = np.unique(right["own"].to_numpy(), return_inverse=True)
        member = np.zeros((len(code), len(labels)))
        member[np.arange(len(code)), code] = 1.0
        sums = gaps @ member
        each = len(labels)
        return pa.table(
            {
                "id": pa.array(np.repeat(left["id"].to_numpy(), each), pa.int64()),
                "own": pa.array(np.repeat(left["own"].to_numpy(), each), pa.int32()),
                "other": pa.array(np.tile(labels, left.num_rows), pa.int32()),
                "total": pa.array(sums.ravel()),
                "members": pa.array(np.tile(member.sum(axis=0).astype("int64"), left.num_rows)),
            }
        )

    rows = rows.select(F.col("id").cast("bigint"), F.col("own").cast("int"), "vector")
    sums = compare_blocks(rows, "id", n_blocks, distance_sums, _SUMS_DDL)
    to_cluster = sums.groupBy("id", "own", "other").agg(
        F.sum("total").alias("total"), F.sum("members").alias("members")
    )
    is_own = F.col("own") == F.col("other")
    per_row = to_cluster.groupBy("id", "own").agg(
        F.max(F.when(is_own, F.col("members"))).alias("size"),
        F.max(F.when(is_own, F.col("total"))).alias("inside"),
        F.min(F.when(~is_own, F.col("total") / F.col("members"))).alias("b"),
    )
    a = F.col("inside") / (F.col("size") - 1)
    widest = F.greatest(a, F.col("b"))
    score = F.when((F.col("size") == 1) | (widest == 0), 0.0).otherwise((F.col("b") - a) / widest)
    # The sizes of the clusters' members add up to one share of 1 per cluster.
    n_labels = F.round(F.sum(1 / F.col("size")))
    usable = (n_labels >= 2) & (n_labels < F.count(F.lit(1)))
    return per_row.agg(F.when(usable, F.avg(score)).alias("silhouette_score"))


_SUMS = pa.schema(
    [
        ("id", pa.int64()),
        ("own", pa.int32()),
        ("other", pa.int32()),
        ("total", pa.float64()),
        ("members", pa.int64()),
    ]
)
_SUMS_DDL = "id bigint, own int, other int, total double, members bigint"


def silhouette_fast(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """Silhouette with squared Euclidean distance over all rows, in one pass without pairs."""
    points = df.select(to_ml(F.col(vector)).alias("features"), F.col(cluster).alias("prediction"))
    score = ClusteringEvaluator(
        featuresCol="features", predictionCol="prediction", distanceMeasure="squaredEuclidean"
    ).evaluate(points)
    return df.sparkSession.createDataFrame([(score,)], "silhouette_squared double")


def davies_bouldin(
    df: DataFrame,
    vector: str = "vector",
    cluster: str = "cluster",
    key: str = "doc_id",
) -> DataFrame:
    """Mean over clusters of the worst ratio of within-cluster spread to centroid distance."""
    rows = df.select(F.col(key).alias("id"), F.col(cluster).alias("cluster"), F.col(vector).alias("vector"))
    centers = cut_lineage(centroids(rows, "vector", "cluster"))
    width = centers.agg(F.max(F.size("centroid"))).first()[0] or 1
    spread = (
        per_cluster_join(rows, centers, "cluster", width, F.col("id"))
        .groupBy("cluster")
        .agg(
            F.avg(distance(F.col("vector"), F.col("centroid"))).alias("spread"),
            F.count(F.lit(1)).alias("size"),
        )
    )
    described = spread.join(centers.select("cluster", "centroid"), "cluster").select(
        F.col("cluster").cast("string").alias("cluster"), "size", "spread", "centroid"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _RATIOS.empty_table()
        gap = distances(left, right, "centroid")
        width = np.add.outer(left["spread"].to_numpy(), right["spread"].to_numpy())
        ratio = np.divide(width, gap, out=np.zeros_like(gap), where=gap > 0)
        return pa.table(
            {
                "cluster": left["cluster"],
                "size": left["size"],
                "spread": left["spread"],
                "worst": pa.array(ratio.max(axis=1)),
                "farthest": pa.array(gap.max(axis=1)),
            }
        )

    # A cluster's distance to itself is 0 and drops out like that of coinciding centroids.
    n_blocks = blocks_for(centers.count())
    per_cluster = (
        compare_blocks(described, "cluster", n_blocks, compare, _RATIOS_DDL)
        .groupBy("cluster", "size", "spread")
        .agg(F.max("worst").alias("worst"), F.max("farthest").alias("farthest"))
    )
    k, n = F.count(F.lit(1)), F.sum("size")
    flat = (F.max("spread") <= NEAR_ZERO) | (F.max("farthest") <= NEAR_ZERO)
    return per_cluster.agg(
        F.when((k >= 2) & (k < n), F.when(flat, 0.0).otherwise(F.avg("worst"))).alias(
            "davies_bouldin_index"
        )
    )


_RATIOS = pa.schema(
    [
        ("cluster", pa.string()),
        ("size", pa.int64()),
        ("spread", pa.float64()),
        ("worst", pa.float64()),
        ("farthest", pa.float64()),
    ]
)
_RATIOS_DDL = "cluster string, size bigint, spread double, worst double, farthest double"


def evaluate(
    df: DataFrame,
    config: EvaluationConfig = EvaluationConfig(),
    vector: str = "vector",
    cluster: str = "cluster",
    key: str = "doc_id",
) -> DataFrame:
    """All chosen metrics in one row; ``cluster_sizes`` is a map in ascending label order."""
    sizes = cluster_sizes(df, cluster)
    ordered = F.map_from_entries(F.array_sort(F.collect_list(F.struct(cluster, "size"))))
    n_clusters = F.count(F.when(F.col(cluster) != -1, F.lit(1)))
    row = sizes.agg(
        n_clusters.alias("n_clusters_found"),
        F.sum("size").alias("n_samples"),
        ordered.alias("cluster_sizes"),
    )
    columns = ["n_clusters_found", "n_samples"]
    if config.compute_silhouette:
        score = silhouette(df, vector, cluster, key, config.silhouette_sample_size, config.seed)
        row = row.withColumn("silhouette_score", score.scalar())
        columns.append("silhouette_score")
    if config.compute_davies_bouldin:
        row = row.withColumn(
            "davies_bouldin_index", davies_bouldin(df, vector, cluster, key).scalar()
        )
        columns.append("davies_bouldin_index")
    return row.select(*columns, "cluster_sizes")
