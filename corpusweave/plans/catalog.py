"""Every operator as a query on the provided tables; see ``oracles`` for the matching SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.functions import vectors as vx
from corpusweave.operators import agglomerative as ag
from corpusweave.operators import dense, evaluate, gmm, interpret, kmeans, neighbours
from corpusweave.operators import pca, plotdata, sampling, svd, tfidf
from corpusweave.operators.bounds import spread
from corpusweave.operators.lemmas import lemmatize_by_table
from corpusweave.plans import presets
from corpusweave.plans.config import CacheConfig, ExperimentConfig
from corpusweave.plans.experiment import run_experiment
from corpusweave.session import scratch_path, set_down, ship_package
from corpusweave.sources import corpus, store

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
TOKEN_LIMIT = 50

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query under its function's name; a trailing underscore only avoids a clash."""

    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__.removesuffix("_")] = prepared
    return run


# --- the tables -------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table with its labels as a given clustering."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        vx.to_double(F.col("embedding")).alias("vector"),
        F.col("label").alias("cluster"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cleaned, with a vector measured on the raw text and the source's number as a given cluster."""
    text = F.coalesce("text", F.lit(""))
    e = F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))
    measures = F.array(F.length(text), F.size(F.split(text, " ")), e).cast("array<double>")
    cluster = F.coalesce(F.expr("try_cast(substring(source, 4) AS int)"), F.lit(-1))
    return spread_documents(spark, sf_dir).select(
        "doc_id", tx.standard_preprocess(F.col("text")).alias("text"), F.col("source").alias("name"), measures.alias("vector"), cluster.alias("cluster")
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


def _sizes_text() -> F.Column:
    entry = lambda e: F.concat_ws(":", e["key"], e["value"])
    return F.array_join(F.transform(F.map_entries("cluster_sizes"), entry), " ")


# --- sources and sinks --------------------------------------------------------------------------


@query
def load_corpus(spark, sf_dir):
    return corpus.load_corpus(spark, f"{sf_dir}/documents.parquet", name="source")


@query
def load_corpus_csv(spark, sf_dir):
    """The corpus written as CSV, line breaks and quotes included, and loaded again."""
    path = scratch_path(spark, "corpus") + ".csv"
    docs = documents(spark, sf_dir).withColumnRenamed("source", "name")
    docs.write.csv(path, header=True, quote='"', escape='"')
    return corpus.load_corpus(spark, path)


@query
def load_corpus_without_key(spark, sf_dir):
    """Numbering rows that have no key; every row keeps its text."""
    docs = corpus.number_documents(documents(spark, sf_dir).select("text", "source"))
    numbers = F.count_distinct("doc_id").alias("n_ids")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), numbers, F.sum(F.length("text")).alias("n_chars")
    )


@query
def write_labels(spark, sf_dir):
    path = scratch_path(spark, "labels")
    store.write_labels(vectors(spark, sf_dir), path)
    return spark.read.parquet(path)


def _metrics_row(metrics: DataFrame) -> DataFrame:
    row = metrics.withColumn("cluster_sizes", _sizes_text())
    return rounded(row, "silhouette_score", "davies_bouldin_index")


@query
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    store.write_metrics(evaluate.evaluate(vectors(spark, sf_dir)), path)
    return _metrics_row(store.read_metrics(spark, path))


@query
def write_interpretations(spark, sf_dir):
    path = scratch_path(spark, "interpretations")
    store.write_interpretations(_summary(spark, sf_dir), path)
    return spark.read.json(path).select(
        F.col("cluster_id").cast("int").alias("cluster_id"),
        "size",
        "closest_sample_index",
        "closest_sample_name",
        "closest_sample_text",
        "top_keywords",
    )


@query
def save_model(spark, sf_dir):
    """A K-Means model saved and loaded again must assign every row as before."""
    rows = vectors(spark, sf_dir).drop("cluster")
    fitted = kmeans.fit_kmeans(spread(rows), 10, n_init=1)
    path = scratch_path(spark, "model")
    store.save_model(spark, fitted, path)
    both = store.load_model(spark, path).predict(fitted.predict(rows, "before"), "after")
    same = F.count(F.when(F.col("before") == F.col("after"), F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), same.alias("n_equal"))


@query
def stage_cache(spark, sf_dir):
    """The second call reads what the first one wrote."""
    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, "cache")
    mark = store.stage_mark("clean", {"kind": "standard"}, store.content_identity(docs))

    def build() -> DataFrame:
        return docs.select("doc_id", tx.standard_preprocess(F.col("text")).alias("clean_text"))

    store.cached_stage(spark, folder, "clean", mark, build)
    return store.cached_stage(spark, folder, "clean", mark, build)


# --- cleaning -----------------------------------------------------------------------------------


def _on_text(spark, sf_dir, column: F.Column, name: str) -> DataFrame:
    return spread_documents(spark, sf_dir).select("doc_id", column.alias(name))


@query
def blank_to_empty(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", tx.blank_to_empty(F.col("text")).alias("clean_text"))


@query
def lowercase(spark, sf_dir):
    return _on_text(spark, sf_dir, tx.lowercase(F.col("text")), "clean_text")


@query
def strip_punct(spark, sf_dir):
    return _on_text(spark, sf_dir, tx.strip_punct(F.col("text")), "clean_text")


@query
def collapse_ws(spark, sf_dir):
    return _on_text(spark, sf_dir, tx.collapse_ws(F.col("text")), "clean_text")


def _tokens() -> F.Column:
    return tx.standard_tokens(F.col("text"))


def _positions(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.select("doc_id", F.posexplode(tokens).alias("pos", "token"))


@query
def tokenize_ws(spark, sf_dir):
    tokens = tx.tokenize_ws(F.col("text")).alias("tokens")
    return _positions(spread_documents(spark, sf_dir).select("doc_id", tokens))


@query
def lemmatize(spark, sf_dir):
    """Lemmas taken from the corpus: a word in -s whose form without it also occurs."""
    docs = spread_documents(spark, sf_dir).select("doc_id", _tokens().alias("tokens"))
    words = docs.select(F.explode("tokens").alias("form")).distinct()
    stems = words.select(F.col("form").alias("lemma"), F.concat("form", F.lit("s")).alias("form"))
    return _positions(lemmatize_by_table(docs, words.join(stems, "form"))).select(
        "doc_id", "pos", "token"
    )


@query
def lemmatize_small(spark, sf_dir):
    """A handful of lemmas as a literal map."""
    lemmas = {"is": "be", "was": "be", "are": "be", "les": "le", "der": "die"}
    return _on_text(
        spark, sf_dir, tx.join_tokens(tx.lemmatize(_tokens(), lemmas)), "clean_text"
    )


@query
def remove_stopwords(spark, sf_dir):
    kept = tx.remove_stopwords(_tokens())
    return _on_text(spark, sf_dir, tx.join_tokens(kept), "clean_text")


@query
def truncate_tokens(spark, sf_dir):
    kept = tx.truncate_tokens(_tokens(), TOKEN_LIMIT)
    return _on_text(spark, sf_dir, tx.join_tokens(kept), "clean_text")


@query
def join_tokens(spark, sf_dir):
    return _on_text(spark, sf_dir, tx.join_tokens(_tokens()), "clean_text")


@query
def standard_preprocess(spark, sf_dir):
    return _on_text(spark, sf_dir, tx.standard_preprocess(F.col("text")), "clean_text")


@query
def light_preprocess(spark, sf_dir):
    cleaned = tx.light_preprocess(
        F.col("text"), lower=True, remove_punctuation=True, token_limit=TOKEN_LIMIT
    )
    return _on_text(spark, sf_dir, cleaned, "clean_text")


@query
def light_preprocess_whole(spark, sf_dir):
    cleaned = tx.light_preprocess(F.col("text"), lower=True, remove_punctuation=True, token_limit=-1)
    return _on_text(spark, sf_dir, cleaned, "clean_text")


@query
def has_urls(spark, sf_dir):
    found = [
        corpus.has_urls(table(spark, sf_dir, name), column).select(F.lit(name).alias("name"), "has_urls")
        for name, column in (("documents", "text"), ("pages", "html"))
    ]
    return found[0].unionByName(found[1])


@query
def remove_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.remove_urls(F.concat_ws(" ", "url", "html")).alias("clean_text"))


@query
def corpus_profile(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select(
        "text", tx.standard_preprocess(F.col("text")).alias("clean_text")
    )
    return rounded(corpus.corpus_profile(docs, "text", "clean_text"), "avg_chars")


# --- TF-IDF -------------------------------------------------------------------------------------


def _cleaned(spark, sf_dir) -> DataFrame:
    return spread_documents(spark, sf_dir).select(
        "doc_id", tx.standard_preprocess(F.col("text")).alias("text"), "source"
    )


def _frequencies(spark, sf_dir) -> DataFrame:
    return tfidf.term_frequency(tfidf.document_terms(spread_documents(spark, sf_dir).select("doc_id", "text")))


def _statistics(spark, sf_dir) -> DataFrame:
    return tfidf.document_frequency(_frequencies(spark, sf_dir))


def _kept_terms(spark, sf_dir) -> DataFrame:
    n_docs = documents(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return tfidf.within_df_bounds(_statistics(spark, sf_dir), n_docs, 2, 0.95)


@query
def tfidf_tokens(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select("doc_id", tx.terms(F.col("text")).alias("tokens"))
    return _positions(docs)


@query
def ngrams(spark, sf_dir):
    config = tfidf.TfidfConfig(ngram_range=(1, 3))
    docs = tfidf.document_terms(spread_documents(spark, sf_dir).select("doc_id", "text"), config)
    return docs.select("doc_id", F.explode("grams").alias("gram"))


@query
def term_frequency(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query
def document_frequency(spark, sf_dir):
    return _statistics(spark, sf_dir)


@query
def vocab_df_bounds(spark, sf_dir):
    return _kept_terms(spark, sf_dir)


@query
def vocab_max_features(spark, sf_dir):
    return tfidf.most_frequent(_kept_terms(spark, sf_dir), 1_000)


@query
def feature_names(spark, sf_dir):
    kept = tfidf.most_frequent(_kept_terms(spark, sf_dir), 50_000)
    return tfidf.with_term_index(kept).select("term_index", "term")


@query
def feature_names_unbounded(spark, sf_dir):
    """The same numbering without a bound on the vocabulary."""
    everything = _statistics(spark, sf_dir)
    return tfidf.with_term_index(everything, bounded=False).select("term_index", "term")


@query
def idf(spark, sf_dir):
    n_docs = documents(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    weighted = _kept_terms(spark, sf_dir).select("term", tfidf.idf(F.col("df"), n_docs).alias("idf"))
    return rounded(weighted, "idf")


def _fit(docs: DataFrame, **settings) -> tfidf.TfidfModel:
    return tfidf.fit_tfidf(docs, tfidf.TfidfConfig(**settings))


@query
def tfidf_(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    return rounded(_fit(docs).weights(docs, keep_empty=True), "weight")


@query
def tfidf_unbounded(spark, sf_dir):
    """No limit on the vocabulary: the weights are built by joins."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    model = _fit(docs, max_features=None)
    model.small = False
    return rounded(model.weights(docs), "weight")


@query
def tfidf_bigrams(spark, sf_dir):
    docs = _cleaned(spark, sf_dir).select("doc_id", "text")
    return rounded(_fit(docs, ngram_range=(1, 2)).weights(docs), "weight")


@query
def tfidf_vectors(spark, sf_dir):
    """Length and entries of each sparse vector."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    parts = F.unwrap_udt("tfidf")
    total = F.aggregate(parts["values"], F.lit(0.0), lambda s, v: s + v)
    result = _fit(docs).vectors(docs).select(
        "doc_id",
        parts["size"].cast("bigint").alias("n_terms"),
        F.size(parts["indices"]).cast("bigint").alias("non_zeros"),
        total.alias("weight_sum"),
    )
    return rounded(result, "weight_sum")


@query
def tfidf_shape(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    return _fit(docs).shape(docs)


@query
def tfidf_transform(spark, sf_dir):
    """The documents' vocabulary applied to texts it has not seen."""
    model = _fit(spread_documents(spark, sf_dir).select("doc_id", "text"))
    unseen = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return rounded(model.weights(unseen), "weight")


# --- dense vectors ------------------------------------------------------------------------------


class _TextMeasures:
    """An encoder whose vectors SQL can also compute: characters, words, letters e."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" ") + 1, t.count("e")] for t in texts], dtype=float)


@query
def dense_encode(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select(
        "doc_id", tx.light_preprocess(F.col("text"), token_limit=-1).alias("text")
    )
    encoded = dense.dense_encode(docs, _TextMeasures)
    return encoded.select("doc_id", F.posexplode("vector").alias("idx", "value"))


@query
def dense_encode_whole(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select(
        "doc_id", tx.light_preprocess(F.col("text"), token_limit=-1).alias("text")
    )
    encoded = dense.dense_encode(docs, _TextMeasures)
    return encoded.select("doc_id", F.posexplode("vector").alias("idx", "value"))


@query
def dense_encode_hashing(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select(
        "doc_id", tx.light_preprocess(F.col("text"), token_limit=-1).alias("text")
    )
    encoded = dense.dense_encode(docs, lambda: dense.HashingEncoder(64))
    return encoded.select(
        "doc_id",
        F.size("vector").alias("width"),
        F.round(vx.l2_norm(F.col("vector")), DIGITS).alias("norm"),
    )


@query
def precomputed_embeddings(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    ready = dense.precomputed_embeddings(docs, table(spark, sf_dir, "embeddings"))
    cells = ready.select("doc_id", "source", F.posexplode_outer("vector").alias("idx", "value"))
    return rounded(cells, "value").withColumn("idx", F.coalesce("idx", F.lit(-1)))


@query
def word2vec_docs(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).select("doc_id", "text").persist()
    _, scored = dense.fit_word2vec(docs, width=32)
    return scored.select("doc_id", F.posexplode("vector").alias("idx", "value"))


@query
def glove_docs(spark, sf_dir):
    """Word vectors read off the corpus: length, spread and density of each word."""
    statistics = _statistics(spark, sf_dir)
    words = statistics.select(
        "term",
        F.array(
            F.sqrt(F.length("term")),
            F.log(F.col("df") + F.lit(1.0)),
            F.log(F.col("total_tf") / F.col("df") + F.lit(1.0)),
        ).alias("vector"),
    )
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    means = dense.mean_word_vectors(docs, words)
    return rounded(means.select("doc_id", F.posexplode("vector").alias("idx", "value")), "value")


# --- reduction ----------------------------------------------------------------------------------


@query
def pca_(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    reduced = pca.fit_pca(rows, 10).transform(rows)
    return reduced.select("doc_id", F.posexplode("reduced").alias("idx", "value"))


@query
def pca_explained_variance(spark, sf_dir):
    fitted = pca.fit_pca(vectors(spark, sf_dir), 10)
    kept = [(i, float(v)) for i, v in enumerate(fitted.explained_variance_ratio)]
    return spark.createDataFrame(kept, "component int, ratio double")


@query
def covariance(spark, sf_dir):
    return rounded(pca.covariance(vectors(spark, sf_dir)), "cov")


def _lsa(spark, sf_dir) -> DataFrame:
    docs = _cleaned(spark, sf_dir).select("doc_id", "text", "source")
    model = _fit(docs)
    rows = set_down(model.vectors(docs).select("doc_id", "tfidf"), "tfidf")
    return svd.fit_truncated_svd(rows, 20, model.n_terms).transform(rows)


@query
def truncated_svd(spark, sf_dir):
    return _lsa(spark, sf_dir).select("doc_id", F.posexplode("reduced").alias("idx", "value"))


@query
def svd_explained_variance(spark, sf_dir):
    return svd.svd_explained_variance(_lsa(spark, sf_dir))


@query
def sparse_total_variance(spark, sf_dir):
    """The denominator of the explained variance: what keeping every column gives."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    rows = _fit(docs).vectors(docs)
    n = rows.agg(F.count(F.lit(1))).scalar()
    return rounded(svd.total_variance(rows, n).select(F.col("variance").alias("total_variance")), "total_variance")


@query
def knn_graph(spark, sf_dir):
    return rounded(neighbours.knn_graph(vectors(spark, sf_dir), 15), "distance")


@query
def knn_graph_hashed(spark, sf_dir):
    """How many exact neighbour edges there are, and whether hashing in short runs finds nine tenths of them."""
    rows = vectors(spark, sf_dir)
    exact = neighbours.knn_graph(rows, 15).select("src", "dst")
    found = neighbours.knn_graph(rows, 15, method="hashed", run_rows=64).select("src", "dst", F.lit(1).alias("hit"))
    counts = exact.join(found, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("n_edges"), F.count("hit").alias("hits"))
    return counts.select("n_edges", (F.col("hits") >= 0.9 * F.col("n_edges")).alias("recall_reached"))


@query
def fuzzy_graph(spark, sf_dir):
    graph = neighbours.knn_graph(vectors(spark, sf_dir), 15)
    return rounded(neighbours.fuzzy_graph(graph, 15), "weight")


@query
def umap(spark, sf_dir):
    layout = neighbours.spectral_embedding(vectors(spark, sf_dir), 5)
    return layout.select("doc_id", F.posexplode("reduced").alias("idx", "value"))


@query
def to_dense(spark, sf_dir):
    """Sparse TF-IDF on a short vocabulary as dense rows."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    dense_rows = _fit(docs, max_features=50).vectors(docs)
    cells = dense_rows.select(
        "doc_id", F.posexplode(vx.to_dense(F.col("tfidf"))).alias("term_index", "weight")
    )
    return rounded(cells, "weight")


# --- clustering ---------------------------------------------------------------------------------


def _small_space(spark, sf_dir) -> DataFrame:
    rows = spread(vectors(spark, sf_dir)).drop("cluster")
    return pca.fit_pca(rows, 8).transform(rows).select("doc_id", F.col("reduced").alias("vector")).persist()


@query
def kmeans_fit(spark, sf_dir):
    rows = vectors(spark, sf_dir).drop("cluster").persist()
    return kmeans.fit_kmeans(rows, 10).predict(rows).select("doc_id", "cluster")


@query
def kmeans_predict(spark, sf_dir):
    """Nearest of the label means, for every row."""
    rows = vectors(spark, sf_dir)
    centers = interpret.centroids(rows)
    return kmeans.predict_with_centers(rows, centers, output="nearest").select(
        "doc_id", "cluster", "nearest"
    )


@query
def kmeans_centers(spark, sf_dir):
    return rounded(interpret.centroid_entries(vectors(spark, sf_dir)), "value")


@query
def kmeans_inertia(spark, sf_dir):
    return rounded(kmeans.inertia(vectors(spark, sf_dir)), "inertia")


@query
def agglomerative(spark, sf_dir):
    fitted = ag.fit_agglomerative(vectors(spark, sf_dir).drop("cluster"), 15)
    return fitted.labels


@query
def agglomerative_grouped(spark, sf_dir):
    """With fewer summaries than rows, as on a large corpus."""
    rows = spread(vectors(spark, sf_dir)).drop("cluster")
    return ag.fit_agglomerative(rows, 15, max_groups=100).labels


@query
def agglomerative_labels(spark, sf_dir):
    """Predicting returns the stored labels, whatever the vectors say."""
    rows = vectors(spark, sf_dir)
    fitted = ag.AgglomerativeFit(rows.select("doc_id", "cluster"), None, 0)
    return fitted.predict(rows.select("doc_id")).select("doc_id", "cluster")


def _label_mixture(spark, sf_dir) -> tuple[gmm.GmmFit, DataFrame]:
    """A diagonal mixture with the weights, means and variances of the given labels."""
    rows = vectors(spark, sf_dir)
    width = rows.select(F.size("vector")).first()[0]
    k = rows.agg(F.max("cluster")).first()[0] + 1
    mixture = gmm.mixture_from_labels(rows, np.zeros((k, width)))
    return gmm.GmmFit(mixture, ()), rows.drop("cluster")


@query
def gmm_fit(spark, sf_dir):
    fitted = gmm.fit_gmm(_small_space(spark, sf_dir), 5)
    shares = [(i, float(w)) for i, w in enumerate(fitted.mixture.weights)]
    return spark.createDataFrame(shares, "component int, weight double")


@query
def gmm_fit_diag(spark, sf_dir):
    rows = _small_space(spark, sf_dir)
    fitted = gmm.fit_gmm(rows, 5, covariance_type="diag")
    steps = [(i, float(v)) for i, v in enumerate(fitted.log_likelihoods)]
    return spark.createDataFrame(steps, "step int, log_likelihood double")


@query
def gmm_em_step(spark, sf_dir):
    """One step of diagonal EM from the given labels: new weights and means."""
    start, rows = _label_mixture(spark, sf_dir)
    improved, _, _ = gmm.em_step(rows, start.mixture)
    k, width = improved.means.shape
    cells = [
        (j, i, float(improved.weights[j]), float(improved.means[j, i]))
        for j in range(k)
        for i in range(width)
    ]
    stepped = spark.createDataFrame(cells, "component int, idx int, weight double, mean double")
    return rounded(stepped, "weight", "mean")


@query
def gmm_predict(spark, sf_dir):
    fitted, rows = _label_mixture(spark, sf_dir)
    return fitted.predict(rows).select("doc_id", "cluster")


@query
def gmm_predict_proba(spark, sf_dir):
    fitted, rows = _label_mixture(spark, sf_dir)
    return rounded(fitted.predict_proba(rows), "probability")


@query
def gmm_bic(spark, sf_dir):
    fitted, rows = _label_mixture(spark, sf_dir)
    return fitted.bic(rows).select(F.round("bic", 3).alias("bic"))


# --- evaluation ---------------------------------------------------------------------------------


@query
def n_clusters_found(spark, sf_dir):
    return evaluate.n_clusters_found(vectors(spark, sf_dir))


@query
def n_samples(spark, sf_dir):
    return evaluate.n_samples(vectors(spark, sf_dir))


@query
def silhouette(spark, sf_dir):
    return rounded(evaluate.silhouette(spread(vectors(spark, sf_dir))), "silhouette_score")


@query
def silhouette_fast(spark, sf_dir):
    return rounded(evaluate.silhouette_fast(vectors(spark, sf_dir)), "silhouette_squared")


@query
def sample_n(spark, sf_dir):
    return sampling.sample_n(documents(spark, sf_dir).select("doc_id", "source"), 300)


@query
def davies_bouldin(spark, sf_dir):
    return rounded(evaluate.davies_bouldin(vectors(spark, sf_dir)), "davies_bouldin_index")


@query
def cluster_sizes(spark, sf_dir):
    return evaluate.cluster_sizes(vectors(spark, sf_dir))


@query
def evaluate_(spark, sf_dir):
    return _metrics_row(evaluate.evaluate(vectors(spark, sf_dir)))


# --- interpretation -----------------------------------------------------------------------------


@query
def centroids(spark, sf_dir):
    return rounded(interpret.centroid_entries(vectors(spark, sf_dir)), "value")


@query
def closest_to_centroid(spark, sf_dir):
    return rounded(interpret.closest_to_centroid(vectors(spark, sf_dir)), "distance")


def _closest(spark, sf_dir, shown: str) -> DataFrame:
    """The document shown for every source, by what its text measures, and for every label, by its embedding."""
    measured = labelled_documents(spark, sf_dir)
    embedded = vectors(spark, sf_dir).where("vector is not null and not exists(vector, x -> x is null)")
    texts = measured.select("doc_id", "text", "name")
    found = [
        interpret.excerpts(interpret.closest_to_centroid(rows), texts, name="name").select(F.lit(kind).alias("kind"), "cluster", "doc_id", shown)
        for kind, rows in (("text", measured), ("embedding", embedded))
    ]
    return found[0].unionByName(found[1])


@query
def closest_text(spark, sf_dir):
    return _closest(spark, sf_dir, "closest_sample_text")


@query
def closest_name(spark, sf_dir):
    return _closest(spark, sf_dir, "closest_sample_name")


@query
def top_keywords(spark, sf_dir):
    """Flagship: each source's best terms over the whole cleaned corpus."""
    docs = _cleaned(spark, sf_dir)
    model = _fit(docs.select("doc_id", "text"))
    weights = tfidf.entries(model.vectors(docs), "tfidf", ["source"])
    best = interpret.top_keywords(
        weights, evaluate.cluster_sizes(docs, "source"), 15, "source", "term_index"
    )
    named = interpret.with_terms(best, model.vocabulary)
    return rounded(named.select("source", "rank", "term", "mean_weight"), "mean_weight")


@query
def cluster_size(spark, sf_dir):
    return evaluate.cluster_sizes(documents(spark, sf_dir), "source")


def _summary(spark, sf_dir) -> DataFrame:
    rows = labelled_documents(spark, sf_dir).persist()
    model = _fit(rows.select("doc_id", "text"))
    summary = interpret.interpret(
        model.vectors(rows), name="name", tfidf="tfidf", vocabulary=model.vocabulary
    )
    return summary.withColumn("top_keywords", F.array_join("top_keywords", " "))


@query
def interpret_(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def cluster_term_weights(spark, sf_dir):
    docs = _cleaned(spark, sf_dir)
    return rounded(interpret.cluster_term_weights(docs, cluster="source"), "weight")


# --- plot tables --------------------------------------------------------------------------------


@query
def scatter_pca(spark, sf_dir):
    return plotdata.scatter_pca(vectors(spark, sf_dir))


@query
def scatter_umap(spark, sf_dir):
    return plotdata.scatter_umap(vectors(spark, sf_dir))


@query
def scatter_all(spark, sf_dir):
    return plotdata.scatter_all(vectors(spark, sf_dir), ["pca", "tsne"])


@query
def dendrogram_merges(spark, sf_dir):
    return plotdata.dendrogram_merges(vectors(spark, sf_dir))


@query
def size_histogram(spark, sf_dir):
    return plotdata.size_histogram(evaluate.cluster_sizes(vectors(spark, sf_dir)))


@query
def size_share(spark, sf_dir):
    return plotdata.size_share(evaluate.cluster_sizes(vectors(spark, sf_dir)))


# --- whole experiments --------------------------------------------------------------------------


def run_whole(spark, sf_dir, config: ExperimentConfig, **options) -> DataFrame:
    config = dataclasses.replace(config, cache=CacheConfig(enabled=False))
    docs = spread_documents(spark, sf_dir).withColumnRenamed("source", "name")
    summary = run_experiment(docs, config, **options).summary
    if "top_keywords" in summary.columns:
        summary = summary.withColumn("top_keywords", F.array_join("top_keywords", " "))
    return summary


@query
def run_experiment_(spark, sf_dir):
    """A small experiment that also writes all its results and uses the stage cache."""
    folder = scratch_path(spark, "experiment")
    config = ExperimentConfig.from_dict(
        {
            "name": "small",
            "tfidf_embedding": {"max_features": 5_000, "min_df": 3, "max_df": 0.9},
            "reduction": {"method": "truncated_svd", "n_components": 20},
            "clustering": {"algorithm": "kmeans", "n_clusters": 8, "extra_params": {"n_init": 3}},
            "visualization": {"scatter_methods": ["pca"]},
            "cache": {"cache_dir": f"{folder}/cache"},
        }
    )
    docs = spread_documents(spark, sf_dir).withColumnRenamed("source", "name")
    result = run_experiment(docs, config, output_dir=f"{folder}/small")
    return result.summary.withColumn("top_keywords", F.array_join("top_keywords", " "))


@query
def preset_tfidf_kmeans(spark, sf_dir):
    return run_whole(spark, sf_dir, presets.TFIDF_KMEANS)


@query
def preset_tfidf_gmm(spark, sf_dir):
    return run_whole(spark, sf_dir, presets.TFIDF_GMM)


@query
def preset_dense_ward(spark, sf_dir):
    return run_whole(
        spark, sf_dir, presets.DENSE_WARD, make_encoder=lambda: dense.HashingEncoder(128)
    )
