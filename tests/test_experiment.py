import dataclasses
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import kmeans, svd, tfidf
from corpusweave.operators.dense import HashingEncoder
from corpusweave.plans import presets
from corpusweave.plans.config import ExperimentConfig, load_config
from corpusweave.plans.experiment import preprocess, run_experiment
from corpusweave.session import scratch_path, scratch_scope, set_down, shared_dir
from corpusweave.sources import corpus, store
from corpusweave.streaming.scoring import load_scorer, score_documents

THEMES = {
    "sky": "star planet moon orbit telescope galaxy comet",
    "sea": "ship sailor harbour anchor wave captain island",
    "food": "bread butter cheese oven recipe flour sugar",
}


@pytest.fixture(scope="module")
def themed(spark):
    rows = []
    for i in range(60):
        theme = list(THEMES)[i % 3]
        words = THEMES[theme].split()
        picked = [words[(i * 7 + j * 3) % 7] for j in range(5)] + [words[0]]
        rows.append((i, "The " + " and ".join(picked), theme))
    return spark.createDataFrame(rows, "doc_id bigint, text string, name string").repartition(3)


def config(folder, **changes):
    raw = {
        "name": "themes",
        "tfidf_embedding": {"ngram_range": [1, 1], "max_features": 500, "min_df": 2, "max_df": 0.9},
        "reduction": {"method": "truncated_svd", "n_components": 4},
        "clustering": {"algorithm": "kmeans", "n_clusters": 3, "extra_params": {"n_init": 3}},
        "visualization": {"scatter_methods": ["pca", "tsne"]},
        "cache": {"cache_dir": f"{folder}/cache"},
    }
    return ExperimentConfig.from_dict({**raw, **changes})


def one_theme_each(result):
    pairs = result.rows.select("cluster", F.col("name")).distinct().collect()
    return len(pairs) == len({p[0] for p in pairs}) == 3


def test_experiment_finds_and_explains_themes(spark, themed, tmp_path):
    result = run_experiment(themed, config(tmp_path), output_dir=str(tmp_path / "out"))
    assert one_theme_each(result)
    for row in result.summary.collect():
        words = set(THEMES[row["closest_sample_name"]].split())
        assert row["size"] == 20 and set(row["top_keywords"]) <= words
    out = tmp_path / "out"
    assert spark.read.parquet(f"{out}/cluster_labels").count() == 60
    metrics = store.read_metrics(spark, f"{out}/metrics/metrics").first()
    assert metrics["silhouette_score"] > 0.3 and sum(metrics["cluster_sizes"].values()) == 60
    assert spark.read.parquet(f"{out}/plots/scatter").select("method").distinct().count() == 1
    assert spark.read.json(f"{out}/interpretations/cluster_interpretations").count() == 3
    result.release()
    loaded = store.load_model(spark, f"{out}/models/clusterer")
    assert isinstance(loaded, kmeans.KMeansFit)


@pytest.mark.parametrize(
    "changes",
    [
        {"clustering": {"algorithm": "gmm", "n_clusters": 3, "extra_params": {"covariance_type": "diag"}}},
        {"clustering": {"algorithm": "agglomerative", "n_clusters": 3}},
        {"reduction": {"method": "pca", "n_components": 4}},
    ],
)
def test_other_methods(themed, tmp_path, changes):
    assert one_theme_each(run_experiment(themed, config(tmp_path, **changes)))


def test_dense_experiment(themed, tmp_path):
    dense = config(
        tmp_path,
        embedding_method="sentence_transformer",
        reduction={"method": "pca", "n_components": 6},
        clustering={"algorithm": "agglomerative", "n_clusters": 3},
    )
    result = run_experiment(themed, dense, make_encoder=lambda: HashingEncoder(256), encoder_id="hashing-256")
    assert result.summary.columns[-1] == "closest_sample_name"
    assert one_theme_each(result)
    with pytest.raises(ValueError):
        run_experiment(themed, dense)
    with pytest.raises(ValueError):  # a cached run must say which encoder it uses
        run_experiment(themed, dense, make_encoder=lambda: HashingEncoder(256))


def test_encoders_never_share_a_cache_entry(themed, tmp_path):
    dense = config(
        tmp_path,
        embedding_method="sentence_transformer",
        reduction={"method": "pca", "n_components": 4},
        clustering={"algorithm": "kmeans", "n_clusters": 3},
    )
    found = []
    for width in (32, 64):
        result = run_experiment(themed, dense, make_encoder=lambda w=width: HashingEncoder(w), encoder_id=f"hashing-{width}")
        found.append(len(result.rows.first()["vector"]))
    assert found == [32, 64]


def test_cache_is_reused_and_never_shared(spark, themed, tmp_path):
    folder = tmp_path / "cache"
    run_experiment(themed, config(tmp_path))
    first = {p.name: p.stat().st_mtime for p in folder.iterdir()}
    run_experiment(themed, config(tmp_path))
    assert {p.name: p.stat().st_mtime for p in folder.iterdir()} == first
    run_experiment(themed, config(tmp_path, preprocessing={"token_limit": 5}))
    assert len(list(folder.iterdir())) == 2 * len(first) == 6


def test_stage_without_success_marker_is_rebuilt(spark, tmp_path):
    path = tmp_path / "s_x"
    path.mkdir()
    (path / "part").write_text("half")
    built = store.cached_stage(spark, str(tmp_path), "s", "x", lambda: spark.range(3))
    assert built.count() == 3


def test_identity_ignores_order_and_sees_changes(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    assert store.content_identity(df) == store.content_identity(df.repartition(5))
    assert store.content_identity(df) != store.content_identity(df.withColumn("v", F.col("v") + 1))


@pytest.mark.parametrize(
    "bad",
    [
        {"embedding_method": "bert"},
        {"reduction": {"method": "tsne"}},
        {"reduction": {"method": "lda"}},
        {"reduction": {"method": "pca", "extra_params": {"colour": 1}}},
        {"clustering": {"algorithm": "dbscan"}},
        {"clustering": {"algorithm": "gmm", "extra_params": {"covariance_type": "round"}}},
        {"sentence_transformer_embedding": {"lemmatize": True}},
        {"visualization": {"scatter_methods": ["mds"]}},
    ],
)
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        ExperimentConfig.from_dict({"name": "x", **bad})


def test_unknown_settings_are_refused_and_idle_ones_warn():
    with pytest.raises(TypeError):
        ExperimentConfig.from_dict({"name": "x", "evaluation": {"compute": True}})
    with pytest.raises(ValueError):
        ExperimentConfig.from_dict({"name": "x", "reductoin": {}})
    assert ExperimentConfig.from_dict({"name": "x", "output_dir": "z"}).output_dir == "z"
    with pytest.warns(UserWarning, match="min_dist"):
        ExperimentConfig.from_dict({"name": "x", "reduction": {"method": "umap", "extra_params": {"min_dist": 0.1}}})


def test_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("name: n\ntfidf_embedding:\n  ngram_range: [1, 2]\nclustering:\n  n_clusters: 4\n")
    loaded = load_config(str(path))
    assert loaded.tfidf_embedding.ngram_range == (1, 2) and loaded.clustering.n_clusters == 4


def test_presets():
    assert set(presets.PRESETS) == {"tfidf_kmeans", "tfidf_gmm", "dense_ward"}
    assert presets.TFIDF_KMEANS.clustering.n_clusters == 15


def test_lemmas_and_cleaning_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Cats are running!")], "doc_id bigint, text string")
    table = spark.createDataFrame([("cats", "cat"), ("running", "run")], "form string, lemma string")
    plain = config(tmp_path)
    assert preprocess(docs, plain, table).first()["text"] == "cat run"
    assert preprocess(docs, plain, {"cats": "cat"}).first()["text"] == "cat running"
    off = dataclasses.replace(plain.preprocessing, lemmatize=False, remove_stopwords=False)
    kept = preprocess(docs, dataclasses.replace(plain, preprocessing=off), table)
    assert kept.first()["text"] == "the cats are running"


def test_csv_corpus(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('URI,name,text\nu1,"Ann ""A"" B","one,\ntwo"\nu2,Bo,\nu3,Cy,NA\nu2,Bo,\n')
    docs = corpus.load_corpus(spark, str(path), na_values=["NA"])
    rows = docs.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 1, 2, 3]
    assert sorted((r["name"], r["text"]) for r in rows) == [('Ann "A" B', "one,\ntwo"), ("Bo", ""), ("Bo", ""), ("Cy", "")]
    again = corpus.load_corpus(spark, str(path), na_values=["NA"]).orderBy("doc_id").collect()
    assert again == rows
    assert corpus.corpus_head(docs, 2).count() == 2
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        corpus.load_corpus(spark, str(tmp_path / "bad.csv"))


def test_numbering_ignores_partitioning_and_spreads_copies(spark):
    texts = spark.range(900).select(F.when(F.col("id") < 300, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    a = corpus.number_documents(texts)
    b = corpus.number_documents(texts.repartition(5))
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.agg(F.min("doc_id"), F.max("doc_id"), F.count_distinct("doc_id")).first()[:] == (0, 899, 900)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_tables_go_with_their_scope(spark):
    kept = set_down(spark.range(3), "kept")
    with scratch_scope(spark):
        inner = set_down(spark.range(4), "inner")
        folder = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
        assert inner.count() == 4 and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 3


def test_scoring_a_stream_equals_scoring_a_batch(spark, themed, tmp_path):
    settings = config(tmp_path)
    cleaned = preprocess(themed, settings)
    embedder = tfidf.fit_tfidf(cleaned, settings.tfidf_embedding)
    vectors = embedder.vectors(cleaned).persist()
    reducer = svd.fit_truncated_svd(vectors, 4, embedder.n_terms)
    clusterer = kmeans.fit_kmeans(reducer.transform(vectors), 3, n_init=2, vector="reduced")
    themed.write.parquet(str(tmp_path / "in"))
    batch = score_documents(themed, settings, embedder, reducer, clusterer)
    stream = spark.readStream.schema(themed.schema).parquet(str(tmp_path / "in"))
    running = (
        score_documents(stream, settings, embedder, reducer, clusterer)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "scored"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination(60)
    scored = spark.read.parquet(str(tmp_path / "scored"))
    columns = ["doc_id", "cluster"]
    assert sorted(scored.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_written_models_score_as_the_experiment_did(spark, themed, tmp_path):
    settings = config(tmp_path)
    done = run_experiment(themed, settings, output_dir=str(tmp_path / "out"))
    own = {r["doc_id"]: r["cluster"] for r in done.labels.collect()}
    again = load_scorer(spark, str(tmp_path / "out"), settings)(themed)
    assert {r["doc_id"]: r["cluster"] for r in again.select("doc_id", "cluster").collect()} == own
    reread = store.load_reducer(spark, str(tmp_path / "out" / "models" / "reducer"))
    assert np.allclose(reread.components, done.reducer.components) and np.allclose(reread.singular_values, done.reducer.singular_values)
    done.release()


def test_dense_experiments_score_new_documents(spark, themed, tmp_path):
    settings = ExperimentConfig.from_dict(
        {
            "name": "dense", "embedding_method": "sentence_transformer", "reduction": {"method": "pca", "n_components": 3},
            "clustering": {"algorithm": "kmeans", "n_clusters": 3, "extra_params": {"n_init": 2}}, "cache": {"enabled": False},
        }
    )
    make = lambda: HashingEncoder(32)
    done = run_experiment(themed, settings, make_encoder=make)
    store.save_reducer(spark, done.reducer, str(tmp_path / "pca"))
    scored = score_documents(themed, settings, None, store.load_reducer(spark, str(tmp_path / "pca")), done.clusterer, make_encoder=make)
    assert sorted(scored.select("doc_id", "cluster").collect()) == sorted(done.labels.collect())
    with pytest.raises(ValueError):
        score_documents(themed, settings, None, done.reducer, done.clusterer)
    done.release()


def test_contradictory_document_bounds_are_an_error(themed):
    with pytest.raises(ValueError, match="max_df"):
        tfidf.fit_tfidf(themed, tfidf.TfidfConfig(min_df=30, max_df=0.1))
