"""One experiment from text to explained clusters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.functions.stopwords import ENGLISH
from corpusweave.functions.vectors import to_dense, to_ml
from corpusweave.operators.agglomerative import AgglomerativeFit, fit_agglomerative
from corpusweave.operators.dense import Encoder, dense_encode
from corpusweave.operators.evaluate import cluster_sizes, evaluate
from corpusweave.operators.gmm import GmmFit, fit_gmm
from corpusweave.operators.interpret import cluster_term_weights, interpret
from corpusweave.operators.kmeans import KMeansFit, fit_kmeans
from corpusweave.operators.lemmas import lemmatize_by_table
from corpusweave.operators.neighbours import spectral_embedding
from corpusweave.operators.pca import PcaFit, fit_pca
from corpusweave.operators.plotdata import (
    dendrogram_merges,
    scatter_all,
    size_histogram,
    size_share,
)
from corpusweave.operators.svd import SvdFit, fit_truncated_svd
from corpusweave.operators.tfidf import TfidfModel, fit_tfidf
from corpusweave.plans.config import ExperimentConfig, load_config
from corpusweave.session import ship_package
from corpusweave.sources import store
from corpusweave.sources.corpus import load_corpus

Lemmas = Mapping[str, str] | DataFrame | None


@dataclass(frozen=True)
class Experiment:
    """What an experiment found; the tables are lazy, ``rows`` is the cached working table."""

    config: ExperimentConfig
    rows: DataFrame
    clusterer: KMeansFit | GmmFit | AgglomerativeFit
    embedder: TfidfModel | None
    reducer: SvdFit | PcaFit | None
    metrics: DataFrame
    summary: DataFrame
    term_weights: DataFrame

    @property
    def labels(self) -> DataFrame:
        return self.rows.select("doc_id", "cluster")

    def scatter(self) -> DataFrame | None:
        return scatter_all(self.rows, list(self.config.visualization.scatter_methods), "reduced")

    def dendrogram(self) -> DataFrame:
        size = self.config.visualization.dendrogram_sample_size
        return dendrogram_merges(self.rows, size, vector="reduced")

    def size_tables(self) -> tuple[DataFrame, DataFrame]:
        sizes = cluster_sizes(self.rows)
        return size_histogram(sizes), size_share(sizes)

    def release(self) -> None:
        """Free the cached working table."""
        self.rows.unpersist()

    def write(self, folder: str | None = None) -> str:
        """Write all results below ``folder`` (default: the experiment's own output folder)."""
        spark = self.rows.sparkSession
        folder = folder or f"{self.config.output_dir}/{self.config.name}"
        store.write_labels(self.rows, f"{folder}/cluster_labels")
        store.save_model(spark, self.clusterer, f"{folder}/models/clusterer")
        if self.embedder is not None:
            self.embedder.save(f"{folder}/models/vocabulary")
        if self.reducer is not None:
            store.save_reducer(spark, self.reducer, f"{folder}/models/reducer")
        store.write_metrics(self.metrics, f"{folder}/metrics/metrics")
        store.write_interpretations(
            self.summary, f"{folder}/interpretations/cluster_interpretations"
        )
        self.term_weights.write.mode("overwrite").parquet(f"{folder}/interpretations/term_weights")
        plots = f"{folder}/plots"
        points = self.scatter()
        if points is not None:
            points.write.mode("overwrite").partitionBy("method").parquet(f"{plots}/scatter")
        self.dendrogram().write.mode("overwrite").parquet(f"{plots}/dendrogram")
        histogram, share = self.size_tables()
        histogram.write.mode("overwrite").parquet(f"{plots}/cluster_sizes")
        share.write.mode("overwrite").parquet(f"{plots}/cluster_shares")
        return folder


def preprocess(docs: DataFrame, config: ExperimentConfig, lemmas: Lemmas = None) -> DataFrame:
    """Replace ``text`` by its cleaned form."""
    text = F.col("text")
    if config.embedding_method != "tfidf":
        light = config.sentence_transformer_embedding
        cleaned = tx.light_preprocess(
            text,
            lower=light.lowercase,
            remove_punctuation=light.remove_punctuation,
            token_limit=light.token_limit,
        )
        return docs.withColumn("text", cleaned)
    full = config.preprocessing
    tokens = tx.standard_tokens(
        text, lower=full.lowercase, remove_punctuation=full.remove_punctuation
    )
    docs = docs.withColumn("_tokens", tokens)
    if full.lemmatize and isinstance(lemmas, DataFrame):
        docs = lemmatize_by_table(docs, lemmas, "_tokens")
    elif full.lemmatize and lemmas:
        docs = docs.withColumn("_tokens", tx.lemmatize(F.col("_tokens"), lemmas))
    finished = tx.finish_tokens(
        F.col("_tokens"),
        stopwords=ENGLISH if full.remove_stopwords else None,
        token_limit=full.token_limit,
    )
    return docs.withColumn("text", finished).drop("_tokens")


def _fit_embedder(docs: DataFrame, config: ExperimentConfig, path: str | None) -> TfidfModel:
    """The fitted vocabulary, read from ``path`` if an earlier run left it there."""
    spark = docs.sparkSession
    if path is not None and store.is_complete(spark, path):
        return TfidfModel.load(spark, path)
    model = fit_tfidf(docs, config.tfidf_embedding)
    if path is not None:
        model.save(path)
    return model


def _reducer_input(rows: DataFrame, config: ExperimentConfig, embedder: TfidfModel | None) -> DataFrame:
    """``rows`` with the column that the configured projection reads."""
    if config.reduction.method == "truncated_svd":
        return rows if embedder else rows.withColumn("_features", to_ml(F.col("vector")))
    # Dense rows as wide as the vocabulary; the PCA fit refuses more than it can hold.
    return rows.withColumn("vector", to_dense(F.col("tfidf"))) if embedder else rows


def _fit_reducer(rows: DataFrame, config: ExperimentConfig, embedder: TfidfModel | None, path: str | None) -> SvdFit | PcaFit | None:
    """The fitted projection, read from ``path`` if an earlier run left it there; none for a layout."""
    spark = rows.sparkSession
    size, extra = config.reduction.n_components, config.reduction.extra_params
    if config.reduction.method == "umap":
        return None
    if path is not None and store.is_complete(spark, f"{path}/kind"):
        return store.load_reducer(spark, path)
    rows = _reducer_input(rows, config, embedder)
    if config.reduction.method == "pca":
        fitted = fit_pca(rows, size, whiten=extra.get("whiten", False))
    else:
        width = embedder.n_terms if embedder else rows.select(F.size("vector")).first()[0]
        seed = extra.get("random_state", config.seed)
        fitted = fit_truncated_svd(rows, size, width, n_iter=extra.get("n_iter", 5), seed=seed, vector="tfidf" if embedder else "_features")
    if path is not None:
        store.save_reducer(spark, fitted, path)
    return fitted


def _reduce(rows: DataFrame, config: ExperimentConfig, embedder: TfidfModel | None, reducer: SvdFit | PcaFit | None) -> DataFrame:
    """``rows`` with ``reduced``, by the fitted projection or by a layout of the rows themselves."""
    ready = _reducer_input(rows, config, embedder)
    if reducer is not None:
        return reducer.transform(ready).drop("_features")
    extra = config.reduction.extra_params
    layout = spectral_embedding(
        ready, config.reduction.n_components, n_neighbors=extra.get("n_neighbors", 15),
        seed=extra.get("random_state", config.seed), method=extra.get("method", "exact"),
    )
    return ready.join(layout.drop("residual"), "doc_id")


def _cluster(rows: DataFrame, config: ExperimentConfig):
    chosen, extra = config.clustering, config.clustering.extra_params
    fit = {"kmeans": fit_kmeans, "gmm": fit_gmm, "agglomerative": fit_agglomerative}
    fitted = fit[chosen.algorithm](
        rows, chosen.n_clusters, seed=chosen.seed, vector="reduced", **extra
    )
    labelled = fitted.predict(rows)
    return fitted, labelled.drop("probability")


def run_experiment(
    docs: DataFrame,
    config: ExperimentConfig,
    *,
    make_encoder: Callable[[], Encoder] | None = None,
    encoder_id: str | None = None,
    lemmas: Lemmas = None,
    output_dir: str | None = None,
) -> Experiment:
    """Clean, embed, reduce, cluster, score and explain ``docs (doc_id, text[, name])``.

    A document keeps one row through all stages, so no stage joins by ``doc_id`` but those whose
    result is a table of its own (stored labels, graph layouts). ``encoder_id`` is the encoder's name
    and version; it is part of a cache entry's mark, so encoders never share vectors.
    """
    if config.embedding_method != "tfidf" and make_encoder is None:
        raise ValueError("dense embedding needs make_encoder, a function that builds the encoder")
    if config.embedding_method != "tfidf" and config.cache.enabled and not encoder_id:
        raise ValueError("a cached dense embedding needs encoder_id, the encoder's name and version")
    spark = docs.sparkSession
    ship_package(spark)
    name = "name" if "name" in docs.columns else None
    cleaned = preprocess(docs, config, lemmas)

    cached = config.cache.enabled
    folder, lineage = config.cache.cache_dir, ""
    if cached or config.embedding_method == "tfidf":
        cleaned = cleaned.persist()
    if cached:
        # The cleaned text stands for the input, the lemmas and the cleaning settings alike.
        settings = config.settings("tfidf_embedding", "sentence_transformer_embedding")
        settings["method"] = config.embedding_method
        lineage = store.stage_mark("embedded", settings, store.content_identity(cleaned), encoder_id or "")
    embedder = None
    if config.embedding_method == "tfidf":
        embedder = _fit_embedder(cleaned, config, f"{folder}/vocabulary_{lineage}" if cached else None)
        fresh = embedder.vectors(cleaned)
    else:
        fresh = dense_encode(
            cleaned, make_encoder, batch_size=config.sentence_transformer_embedding.batch_size
        )
    if cached:
        embedded = store.cached_stage(spark, folder, "embedded", lineage, lambda: fresh)
        settings = config.settings("reduction") | {"seed": config.seed}
        mark = store.stage_mark("reduced", settings, lineage)
        # inside the stage that it was fitted on, where readers of that stage skip it
        reducer = _fit_reducer(embedded, config, embedder, f"{folder}/embedded_{lineage}/_reducer_{mark}")
        reduced = store.cached_stage(
            spark, folder, "reduced", mark, lambda: _reduce(embedded, config, embedder, reducer)
        )
    else:
        embedded = fresh.persist()
        reducer = _fit_reducer(embedded, config, embedder, None)
        reduced = _reduce(embedded, config, embedder, reducer).persist()

    clusterer, rows = _cluster(reduced, config)
    rows = rows.persist()
    cleaned.unpersist()  # by now the embedded rows are stored or cached themselves
    result = Experiment(
        config=config,
        rows=rows,
        clusterer=clusterer,
        embedder=embedder,
        reducer=reducer,
        metrics=evaluate(rows, config.evaluation, vector="reduced"),
        summary=interpret(
            rows,
            vector="reduced",
            name=name,
            tfidf="tfidf" if embedder else None,
            vocabulary=embedder.vocabulary if embedder else None,
        ),
        term_weights=cluster_term_weights(rows),
    )
    if output_dir is not None:
        result.write(output_dir)
    return result


def run_from_file(spark: SparkSession, path: str, **options) -> Experiment:
    """Run the experiment that a settings file describes, corpus and output folder included."""
    config = load_config(path)
    result = run_experiment(load_corpus(spark, config.data_path), config, **options)
    result.write()
    return result
