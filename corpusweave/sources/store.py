"""Writing results and models, and reusing stage outputs that were written before."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators.agglomerative import AgglomerativeFit
from corpusweave.operators.gmm import GmmFit
from corpusweave.operators.kmeans import KMeansFit
from corpusweave.operators.pca import PcaFit
from corpusweave.operators.svd import SvdFit

Clusterer = KMeansFit | GmmFit | AgglomerativeFit

METRICS_SCHEMA = (
    "n_clusters_found bigint, n_samples bigint, silhouette_score double, "
    "davies_bouldin_index double, cluster_sizes map<string, bigint>"
)


def write_labels(labelled: DataFrame, path: str, key: str = "doc_id", cluster: str = "cluster") -> None:
    labelled.select(key, cluster).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read metrics back; JSON object keys are text, cluster ids are numbers again."""
    metrics = spark.read.schema(METRICS_SCHEMA).json(path)
    sizes = F.transform_keys("cluster_sizes", lambda label, _: label.cast("int"))
    return metrics.withColumn("cluster_sizes", sizes)


def write_interpretations(summary: DataFrame, path: str) -> None:
    """One JSON object per cluster; there are k of them, so they go into one file in id order."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def save_model(spark: SparkSession, fitted: Clusterer, path: str) -> None:
    """Save a fitted clusterer below ``path``."""
    if isinstance(fitted, KMeansFit):
        fitted.save(spark, f"{path}/centers")
        note = {"kind": "kmeans", "vector": fitted.vector, "inertia": fitted.inertia}
    elif isinstance(fitted, GmmFit):
        fitted.save(spark, f"{path}/model")
        note = {"kind": "gmm", "vector": fitted.vector, "inertia": None}
    else:
        fitted.labels.write.mode("overwrite").parquet(f"{path}/labels")
        fitted.merges.write.mode("overwrite").parquet(f"{path}/merges")
        note = {"kind": "agglomerative", "vector": None, "inertia": None}
    kind = spark.createDataFrame([tuple(note.values())], "kind string, vector string, inertia double")
    kind.write.mode("overwrite").json(f"{path}/kind")


def save_reducer(spark: SparkSession, fitted: SvdFit | PcaFit, path: str) -> None:
    """Save a fitted projection below ``path``; its kind is written last, when the rest is there."""
    fitted.save(spark, path)
    kind = "svd" if isinstance(fitted, SvdFit) else "pca"
    spark.createDataFrame([(kind,)], "kind string").write.mode("overwrite").json(f"{path}/kind")


def load_reducer(spark: SparkSession, path: str) -> SvdFit | PcaFit:
    kind = spark.read.schema("kind string").json(f"{path}/kind").first()["kind"]
    return (SvdFit if kind == "svd" else PcaFit).load(spark, path)


def load_model(spark: SparkSession, path: str) -> Clusterer:
    note = spark.read.schema("kind string, vector string, inertia double").json(f"{path}/kind").first()
    if note["kind"] == "kmeans":
        if is_complete(spark, f"{path}/centers"):
            centers = [row["center"] for row in spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()]
        else:  # as models were saved before
            centers = KMeansModel.load(f"{path}/model").clusterCenters()
        return KMeansFit(np.array(centers, dtype=float), note["inertia"], (note["inertia"],), note["vector"])
    if note["kind"] == "gmm":
        return GmmFit.load(spark, f"{path}/model")
    merges = spark.read.parquet(f"{path}/merges")
    return AgglomerativeFit(spark.read.parquet(f"{path}/labels"), merges, merges.count() + 1)


def content_identity(df: DataFrame) -> str:
    """A value that changes with the rows of a table but not with their order or layout."""
    digest = F.xxhash64(*df.columns)
    row = df.agg(
        F.count(F.lit(1)), F.bit_xor(digest), F.sum(digest.cast("decimal(38,0)"))
    ).first()
    return ":".join(str(value) for value in row)


STORE_VERSION = 2  # of what the stages write; older entries are not read


def stage_mark(stage: str, settings: Mapping[str, Any], *sources: str) -> str:
    """Names a stage's output by its settings and by everything that it was made from.

    Each part is hashed on its own with its length, so no two different inputs read the same.
    """
    digest = hashlib.blake2b(digest_size=12, person=b"corpusweave")
    parts = [str(STORE_VERSION), stage, *sources, *(f"{k}={settings[k]!r}" for k in sorted(settings))]
    for part in parts:
        raw = part.encode()
        digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there and its writer finished."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(marker))


def cached_stage(
    spark: SparkSession, folder: str, stage: str, mark: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The stage output stored under its fingerprint, built and written if it is not there yet."""
    path = f"{folder}/{stage}_{mark}"
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
