"""Summaries that tell a reader what each cluster is about; one plan serves all clusters."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.functions import text as tx
from corpusweave.functions.vectors import distance, to_dense, to_ml
from corpusweave.operators.bounds import lookup_join, per_cluster_join
from corpusweave.operators.tfidf import entries
from corpusweave.session import cut_lineage

TIE_DIGITS = 9  # totals whose logarithms agree to this many digits count as tied, at any size
EXCERPT = 500


def centroids(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """``(cluster, centroid)``: the mean vector of each label."""
    return df.groupBy(cluster).agg(
        to_dense(Summarizer.mean(to_ml(F.col(vector)))).alias("centroid")
    )


def centroid_entries(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """Centroids in long form ``(cluster, idx, value)``."""
    return centroids(df, vector, cluster).select(
        cluster, F.posexplode("centroid").alias("idx", "value")
    )


def distance_to_own_centroid(
    df: DataFrame, vector: str = "vector", cluster: str = "cluster", key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, cluster, distance)``."""
    centers = cut_lineage(centroids(df, vector, cluster))
    width = centers.agg(F.max(F.size("centroid"))).first()[0] or 1
    rows = per_cluster_join(df.select(key, cluster, vector), centers, cluster, width, F.col(key))
    return rows.select(key, cluster, distance(F.col(vector), F.col("centroid")).alias("distance"))


def closest_to_centroid(
    df: DataFrame, vector: str = "vector", cluster: str = "cluster", key: str = "doc_id"
) -> DataFrame:
    """``(cluster, doc_id, distance)`` of the row nearest its centroid, ties by lowest id."""
    nearest = F.min(F.struct("distance", key))
    return (
        distance_to_own_centroid(df, vector, cluster, key)
        .groupBy(cluster)
        .agg(nearest.alias("nearest"))
        .select(cluster, f"nearest.{key}", "nearest.distance")
    )


def excerpts(
    picked: DataFrame, docs: DataFrame, text: str = "text", name: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """Add the first 500 characters, and the name if there is one, of the picked documents."""
    shown = [F.substring(text, 1, EXCERPT).alias("closest_sample_text")]
    if name is not None:
        shown.append(F.col(name).alias("closest_sample_name"))
    # `picked` has one row per cluster. It is set down, as finding it takes a pass over all vectors;
    # documents are filtered by it before any text moves.
    picked = cut_lineage(picked)
    found = lookup_join(docs.select(key, *shown), picked.select(key), key, F.col(key))
    return picked.join(found, key, "left")


def top_keywords(
    weights: DataFrame,
    sizes: DataFrame,
    k: int = 15,
    cluster: str = "cluster",
    term: str = "term",
) -> DataFrame:
    """``(cluster, rank, term, mean_weight)``: highest mean TF-IDF over all rows of the cluster.

    ``weights`` holds ``(cluster, term, weight)``. Terms that never occur in a cluster do not fill
    its list. Ranking keeps at most k rows per cluster and task before it shuffles.
    """
    totals = weights.groupBy(cluster, term).agg(F.sum("weight").alias("total"))
    level = F.round(F.log("total"), TIE_DIGITS)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(level.desc(), term))
    best = totals.where("total > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    # One size per cluster, so totals rank as means do; only the few kept rows are divided.
    return best.join(sizes.select(cluster, "size"), cluster).select(
        cluster, term, (F.col("total") / F.col("size")).alias("mean_weight"), "rank"
    )


def with_terms(ranked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Put terms in place of vector indices; a vocabulary with vectors is of bounded size."""
    names = vocabulary.select("term", "term_index")
    return ranked.join(F.broadcast(names), "term_index").drop("term_index")


def keyword_lists(ranked: DataFrame, cluster: str = "cluster", term: str = "term") -> DataFrame:
    """One array of terms per cluster, best first."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", term)))
    return ranked.groupBy(cluster).agg(
        F.transform(in_order, lambda entry: entry[term]).alias("top_keywords")
    )


def interpret(
    df: DataFrame,
    *,
    vector: str = "vector",
    cluster: str = "cluster",
    text: str = "text",
    name: str | None = None,
    tfidf: str | None = None,
    vocabulary: DataFrame | None = None,
    top_k_keywords: int = 15,
    key: str = "doc_id",
) -> DataFrame:
    """One summary row per cluster.

    ``df`` carries everything about a document in one row, so no join by ``doc_id`` is needed.
    ``tfidf`` names its sparse vector column and ``vocabulary`` holds ``(term, term_index)``;
    without them there are no keywords.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    picked = closest_to_centroid(df, vector, cluster, key)
    described = excerpts(picked, df, text, name, key)
    columns = [
        F.col(cluster).alias("cluster_id"),
        "size",
        F.col(key).alias("closest_sample_index"),
        "closest_sample_text",
    ]
    summary = sizes.join(described, cluster)
    if name is not None:
        columns.append("closest_sample_name")
    if tfidf is not None and vocabulary is not None:
        # Indices follow alphabetical order, so ranking by index breaks ties as the terms would.
        best = top_keywords(
            entries(df, tfidf, [cluster]), sizes, top_k_keywords, cluster, "term_index"
        )
        lists = keyword_lists(with_terms(best, vocabulary), cluster)
        columns.append("top_keywords")
        summary = summary.join(lists, cluster, "left")
    return summary.select(*columns).orderBy("cluster_id")


def cluster_term_weights(
    df: DataFrame, text: str = "text", cluster: str = "cluster", max_words: int = 100
) -> DataFrame:
    """``(cluster, term, count, weight)``: the most frequent words, relative to the top one."""
    words = df.select(cluster, F.explode(tx.tokenize_ws(F.col(text))).alias("term"))
    counts = words.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("count"), "term"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= max_words)
    top = F.max("count").over(Window.partitionBy(cluster))
    return kept.select(cluster, "term", "count", (F.col("count") / top).alias("weight"))
