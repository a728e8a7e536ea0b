import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import blocks, evaluate, interpret, kmeans, plotdata
from corpusweave.operators.bounds import lookup_join
from corpusweave.operators.evaluate import EvaluationConfig
from corpusweave.operators.sampling import sample_n


def frame(spark, points, labels):
    rows = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))]
    return spark.createDataFrame(rows, "doc_id bigint, vector array<double>, cluster int").repartition(3)


def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(scores)


def brute_davies_bouldin(x, labels):
    keys = sorted(set(labels))
    centers = np.array([x[labels == k].mean(axis=0) for k in keys])
    spread = [np.linalg.norm(x[labels == k] - c, axis=1).mean() for k, c in zip(keys, centers)]
    if np.allclose(spread, 0):
        return 0.0
    worst = []
    for i in range(len(keys)):
        ratios = [
            (spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j])
            for j in range(len(keys))
            if j != i and np.linalg.norm(centers[i] - centers[j]) > 0
        ]
        worst.append(max(ratios, default=0.0))
    return np.mean(worst)


RNG = np.random.default_rng(3)
CASES = {
    "random": (RNG.normal(size=(50, 3)), RNG.integers(0, 4, 50)),
    "singleton": (RNG.normal(size=(12, 2)), np.array([0] * 6 + [1] * 5 + [2])),
    "noise label": (RNG.normal(size=(20, 2)), np.array([-1] * 5 + [0] * 8 + [3] * 7)),
    "hot cluster": (RNG.normal(size=(60, 2)), np.array([0] * 50 + [1] * 6 + [2] * 4)),
    "copies": (np.repeat(RNG.normal(size=(4, 2)), 8, axis=0), np.repeat([0, 1, 2, 3], 8)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block_rows", [7, 1_000])
def test_silhouette(spark, monkeypatch, case, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    x, labels = CASES[case]
    got = evaluate.silhouette(frame(spark, x, labels), sample_size=None).first()[0]
    assert np.isclose(got, brute_silhouette(x, labels), atol=1e-12) and -1 <= got <= 1


@pytest.mark.parametrize("case", CASES)
def test_davies_bouldin(spark, case):
    x, labels = CASES[case]
    got = evaluate.davies_bouldin(frame(spark, x, labels)).first()[0]
    assert np.isclose(got, brute_davies_bouldin(x, labels), atol=1e-12)


def test_undefined_scores_are_null(spark):
    one = frame(spark, RNG.normal(size=(5, 2)), [0] * 5)
    each = frame(spark, RNG.normal(size=(5, 2)), range(5))
    for df in (one, each):
        assert evaluate.silhouette(df).first()[0] is None
        assert evaluate.davies_bouldin(df).first()[0] is None


def test_evaluate_row(spark):
    x, labels = CASES["noise label"]
    df = frame(spark, x, labels)
    row = evaluate.evaluate(df).first()
    assert row["n_clusters_found"] == 2 and row["n_samples"] == 20
    assert row["cluster_sizes"] == {-1: 5, 0: 8, 3: 7}
    assert evaluate.n_clusters_found(df).first()[0] == 2
    bare = evaluate.evaluate(df, EvaluationConfig(False, False)).columns
    assert bare == ["n_clusters_found", "n_samples", "cluster_sizes"]


def test_sampled_silhouette_scores_the_sample(spark):
    x, labels = CASES["random"]
    df = frame(spark, x, labels)
    kept = sorted(r["doc_id"] for r in sample_n(df, 20).collect())
    expected = brute_silhouette(x[kept], labels[kept])
    assert np.isclose(evaluate.silhouette(df, sample_size=20).first()[0], expected)


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5_000).withColumnRenamed("id", "doc_id")
    first = [r[0] for r in sample_n(df, 700).collect()]
    again = [r[0] for r in sample_n(df.repartition(7), 700).collect()]
    assert len(set(first)) == 700 and first == again
    assert first != [r[0] for r in sample_n(df, 700, seed=1).collect()]
    assert sample_n(df.limit(10), 700).count() == 10
    whole = [r[0] for r in df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))).limit(700).collect()]
    assert first == whole


def test_closest_ties_go_to_the_lowest_id(spark):
    df = frame(spark, [[1.0], [-1.0], [3.0], [5.0]], [0, 0, 1, 1])
    picked = {r["cluster"]: r["doc_id"] for r in interpret.closest_to_centroid(df).collect()}
    assert picked == {0: 0, 1: 2}


def test_salted_join_equals_broadcast(spark):
    facts = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("k"))
    table = spark.createDataFrame([(k, k * 10) for k in range(6)], "k bigint, v bigint")
    for how in ("inner", "left"):
        small, salted = (
            sorted(lookup_join(facts, table, "k", F.col("id"), how=how, small=s).collect(), key=str)
            for s in (True, False)
        )
        assert small == salted


def test_keywords_skip_terms_that_never_occur(spark):
    weights = spark.createDataFrame(
        [(0, "a", 0.5), (0, "b", 0.5), (0, "c", 0.9), (1, "a", 1.0)], "cluster int, term string, weight double"
    )
    sizes = spark.createDataFrame([(0, 2), (1, 4)], "cluster int, size bigint")
    best = interpret.top_keywords(weights, sizes, 2)
    got = sorted((r["cluster"], r["rank"], r["term"], r["mean_weight"]) for r in best.collect())
    assert got == [(0, 1, "c", 0.45), (0, 2, "a", 0.25), (1, 1, "a", 0.25)]
    assert {r["cluster"]: r["top_keywords"] for r in interpret.keyword_lists(best).collect()} == {0: ["c", "a"], 1: ["a"]}


def test_term_weights_skip_blank_clusters(spark):
    rows = [(0, "x y x"), (0, "x"), (1, "  "), (2, None)]
    df = spark.createDataFrame(rows, "cluster int, text string")
    got = sorted(map(tuple, interpret.cluster_term_weights(df).collect()))
    assert got == [(0, "x", 3, 1.0), (0, "y", 1, 1 / 3)]


def test_inertia_and_assignment(spark, blobs, points):
    _, x, labels = points
    centers = np.array([x[labels == k].mean(axis=0) for k in range(3)])
    expected = sum(np.square(x[labels == k] - centers[k]).sum() for k in range(3))
    assert np.isclose(kmeans.inertia(blobs).first()[0], expected)
    moved = kmeans.predict_with_centers(blobs, interpret.centroids(blobs), output="near")
    assert moved.where("near <> cluster").count() == 0


def test_size_tables(spark):
    df = frame(spark, RNG.normal(size=(6, 2)), [10, 10, 10, 2, 2, -1])
    sizes = evaluate.cluster_sizes(df)
    assert [tuple(r) for r in plotdata.size_histogram(sizes).collect()] == [("-1", 1), ("2", 2), ("10", 3)]
    assert {r[0]: r[1] for r in plotdata.size_share(sizes).collect()} == {"-1": 16.7, "2": 33.3, "10": 50.0}
