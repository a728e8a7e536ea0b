import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusweave.operators import agglomerative as ag
from corpusweave.operators import blocks, dense, gmm, kmeans, merging, neighbours, pca, plotdata, svd
from corpusweave.operators.partials import summed
from corpusweave.sources import store


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def labels_of(df):
    return [r["cluster"] for r in df.orderBy("doc_id").collect()]


def test_partial_sums(spark, blobs, points):
    from corpusweave.functions.vectors import matrix_of

    def fold(batches):
        total = np.zeros((400, 400))
        for batch in batches:
            total[:4, :4] += matrix_of(batch.column(0)).T @ matrix_of(batch.column(0))
        return {"x": total}

    got = summed(blobs.select("vector"), fold, {"x": (400, 400)})["x"]
    assert np.allclose(got[:4, :4], points[1].T @ points[1]) and not got[4:].any()


# --- K-Means ------------------------------------------------------------------------------------


def test_kmeans_restarts_share_passes(spark):
    """All restarts move on in one pass over the rows, to the centres that Spark ML finds one by one."""
    from pyspark.ml.clustering import KMeans

    from corpusweave.functions.vectors import to_ml

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, vector array<double>").coalesce(1).persist()
    context = spark.sparkContext
    context.setJobGroup("shared-passes", "")
    fit = kmeans.fit_kmeans(df, 6, n_init=5, max_iter=40, tol=0.0)
    starts = len(context.statusTracker().getJobIdsForGroup("shared-passes"))
    kmeans.fit_kmeans(df, 6, n_init=5, max_iter=10, tol=0.0)
    more = len(context.statusTracker().getJobIdsForGroup("shared-passes")) - starts
    context._jsc.clearJobGroup()
    assert starts - more <= 3 * 30  # thirty passes more, whatever the restarts
    ready = df.select(to_ml(F.col("vector")).alias("f")).persist()
    for restart in range(5):
        alone = KMeans(featuresCol="f", k=6, seed=42 + restart, maxIter=40, tol=0.0).fit(ready)
        assert np.isclose(alone.summary.trainingCost, fit.inertias[restart], rtol=1e-9)
        if fit.inertia == fit.inertias[restart]:
            assert np.allclose(np.array(alone.clusterCenters()), fit.cluster_centers)


def test_kmeans_nearest_rows_of_ties():
    """Equal distances go to the first centre, also far from the origin where products round."""
    rows = np.array([[1e6, 1.0], [1e6, 0.0], [1e6, 3.0]])
    centers = np.array([[1e6, 2.0], [1e6, 0.0], [1e6, 2.0], [1e6, 4.0], [1e6, 2.0]])
    labels, gaps = kmeans.nearest_rows(rows, centers, np.array([2, 5]))
    assert labels.tolist() == [[0, 1, 0], [2, 2, 2]] and np.allclose(gaps, [[1, 0, 1], [1, 4, 1]])


def test_kmeans_recovers_blobs(spark, blobs, points, tmp_path):
    fit = kmeans.fit_kmeans(blobs.drop("cluster"), 3, n_init=4)
    assert fit.inertia == min(fit.inertias) and len(fit.inertias) == 4
    got = labels_of(fit.predict(blobs.drop("cluster")))
    assert same_partition(got, points[2])
    assert np.isclose(kmeans.inertia(fit.predict(blobs.drop("cluster"))).first()[0], fit.inertia)
    assert fit.centers_table(spark).count() == 12
    store.save_model(spark, fit, str(tmp_path / "m"))
    assert labels_of(store.load_model(spark, str(tmp_path / "m")).predict(blobs.drop("cluster"))) == got


def test_lloyd_steps_never_raise_inertia(spark, points):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(points[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, vector array<double>, cluster int")
    seen = []
    for _ in range(4):
        from corpusweave.operators.interpret import centroids

        seen.append(kmeans.inertia(df).first()[0])
        moved = kmeans.predict_with_centers(df, centroids(df), output="next").collect()
        df = spark.createDataFrame([(r["doc_id"], r["vector"], r["next"]) for r in moved], df.schema)
    assert all(a >= b - 1e-9 for a, b in zip(seen, seen[1:]))


# --- mixtures -----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", gmm.COVARIANCE_TYPES)
def test_mixture_recovers_blobs(spark, blobs, points, tmp_path, kind):
    rows = blobs.drop("cluster")
    fit = gmm.fit_gmm(rows, 3, covariance_type=kind)
    scored = fit.predict(rows)
    assert same_partition(labels_of(scored), points[2])
    total = scored.select(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v)).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in total)
    gains = np.diff(fit.log_likelihoods)
    assert (gains > -1e-6).all()
    n, likelihood = fit.log_likelihood(rows)
    d, k = 4, 3
    spread = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind]
    expected = -2 * likelihood + (spread + k * d + k - 1) * np.log(n)
    assert np.isclose(fit.bic(rows).first()[0], expected)
    store.save_model(spark, fit, str(tmp_path / "m"))
    again = store.load_model(spark, str(tmp_path / "m"))
    assert labels_of(again.predict(rows)) == labels_of(scored)


def test_full_covariance_step_matches_numpy(blobs, points):
    _, x, labels = points
    made = gmm.mixture_from_labels(blobs, np.zeros((3, 4)), "full")
    for k in range(3):
        part = x[labels == k]
        assert np.allclose(made.means[k], part.mean(axis=0))
        assert np.allclose(made.covariances[k], np.cov(part.T, bias=True) + 1e-6 * np.eye(4))


def test_copies_do_not_stop_the_fit(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    fit = gmm.fit_gmm(df, 2)
    assert sorted(np.round(fit.mixture.weights, 3)) == [0.5, 0.5]


def test_unknown_covariance_is_refused(blobs):
    with pytest.raises(ValueError):
        gmm.fit_gmm(blobs, 2, covariance_type="round")


# --- agglomerative ------------------------------------------------------------------------------


def brute_heights(x, linkage):
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                if linkage == "ward":
                    factor = 2 * len(a) * len(b) / (len(a) + len(b))
                    height = np.sqrt(factor) * np.linalg.norm(a.mean(axis=0) - b.mean(axis=0))
                else:
                    gaps = np.linalg.norm(a[:, None] - b[None], axis=2)
                    height = {"single": gaps.min, "complete": gaps.max, "average": gaps.mean}[linkage]()
                if best is None or height < best[0]:
                    best = (height, i, j)
        height, i, j = best
        heights.append(height)
        groups[i] += groups.pop(j)
    return heights


@pytest.mark.parametrize("linkage", ag.LINKAGES)
def test_merges_match_brute_force(linkage):
    x = np.random.default_rng(5).normal(size=(25, 3))
    merges = ag.merge_summaries(np.ones(25), x, linkage)
    assert np.allclose(merges[:, 2], brute_heights(x, linkage))
    assert merges[-1, 3] == 25


def test_ward_on_weighted_summaries_is_exact():
    x = np.array([[0.0], [0.0], [0.0], [4.0], [10.0]])
    whole = ag.merge_summaries(np.ones(5), x)[-2:, 2]
    grouped = ag.merge_summaries(np.array([3.0, 1.0, 1.0]), np.array([[0.0], [4.0], [10.0]]))[:, 2]
    assert np.allclose(whole, grouped)


def steps_of(fit):
    return fit.merges.orderBy("step").select("left", "right", "height", "size").toPandas().to_numpy(dtype=float)


@pytest.mark.parametrize(
    "linkage, metric", [("ward", "euclidean"), ("average", "euclidean"), ("average", "cosine"), ("complete", "manhattan"), ("single", "euclidean")]
)
def test_rounds_give_the_tree_of_single_merges(spark, monkeypatch, linkage, metric):
    monkeypatch.setattr("corpusweave.operators.blocks.BLOCK_ROWS", 25)
    monkeypatch.setattr("corpusweave.operators.merging.BLOCK_ROWS", 25)  # late clusters are dealt to several blocks
    x = np.random.default_rng(8).normal(size=(70, 3))
    rows = spark.createDataFrame([(10 + i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>").repartition(4)
    fit = ag.fit_agglomerative(rows, 6, linkage=linkage, metric=metric, rest=24)
    whole = ag.merge_summaries(np.ones(70), x, linkage, metric)
    assert np.allclose(steps_of(fit), whole)
    labels = {r["doc_id"]: r["cluster"] for r in fit.labels.collect()}
    assert [labels[10 + i] for i in range(70)] == ag.cut(whole, 70, 6).tolist()


def test_many_copies_take_few_rounds(spark):
    x = np.random.default_rng(4).normal(size=(60, 4))
    x = np.vstack([x, np.repeat(x[:2], [150, 40], axis=0)])[np.random.default_rng(5).permutation(250)]
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id bigint, weight int, vector array<double>").repartition(4)
    tree = merging.merge_rounds(rows, rest=20)
    assert len(tree.rounds) < 20
    whole, steps = ag.merge_summaries(np.ones(250), x), tree.numbered().orderBy("step").toPandas().to_numpy(dtype=float)
    assert np.allclose(steps[190:, 3:], whole[190:, 2:], atol=1e-7)
    assert (steps[:190, 3] == 0).all() and len({*steps[:, 1], *steps[:, 2]}) == 2 * len(steps) == 498
    labels = {r["id"]: r["cluster"] for r in tree.cut(0, 7).collect()}
    assert [labels[i] for i in range(250)] == ag.cut(whole, 250, 7).tolist()


def test_thousands_of_ward_clusters_take_no_round_over_tables(spark):
    x = np.random.default_rng(6).normal(size=(2_500, 4))
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id bigint, weight int, vector array<double>").repartition(4)
    tree = merging.merge_rounds(rows)
    assert tree.rounds == []
    whole, steps = ag.merge_summaries(np.ones(2_500), x), tree.numbered().orderBy("step").toPandas().to_numpy(dtype=float)
    assert np.allclose(steps[:, 1:], whole)
    labels = {r["id"]: r["cluster"] for r in tree.cut(0, 7).collect()}
    assert [labels[i] for i in range(2_500)] == ag.cut(whole, 2_500, 7).tolist()


def test_ward_rounds_on_500_rows_and_copies(spark):
    x = np.random.default_rng(3).normal(size=(450, 8))
    x = np.vstack([x, np.repeat(x[:5], 10, axis=0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>").repartition(6)
    fit = ag.fit_agglomerative(rows, 12)
    whole = ag.merge_summaries(np.ones(500), x)
    steps = steps_of(fit)
    assert np.allclose(steps[:, 2], whole[:, 2], atol=1e-7) and steps[-1, 3] == 500
    labels = np.array([r["cluster"] for r in fit.labels.orderBy("doc_id").collect()])
    assert same_partition(labels.tolist(), ag.cut(whole, 500, 12).tolist())
    inside = sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in range(12))
    assert np.isclose(inside, (steps[: 500 - 12, 2] ** 2).sum() / 2)


def test_few_rows_merge_too(spark):
    schema = "doc_id bigint, vector array<double>"
    assert ag.fit_agglomerative(spark.createDataFrame([(4, [1.0])], schema), 1).labels.collect() == [(4, 0)]
    pair = ag.fit_agglomerative(spark.createDataFrame([(4, [1.0]), (2, [3.0])], schema), 1)
    assert steps_of(pair).tolist() == [[0, 1, 2.0, 2]] and pair.n_groups == 2


@pytest.mark.parametrize("max_groups", [None, 2_000, 25])
def test_agglomerative_recovers_blobs(spark, blobs, points, tmp_path, max_groups):
    fit = ag.fit_agglomerative(blobs.drop("cluster"), 3, max_groups=max_groups)
    assert same_partition(labels_of(fit.labels), points[2])
    assert fit.labels.count() == len(points[0])
    store.save_model(spark, fit, str(tmp_path / "m"))
    again = store.load_model(spark, str(tmp_path / "m"))
    assert labels_of(again.predict(blobs.select("doc_id"))) == labels_of(fit.labels)
    assert np.allclose(steps_of(again), steps_of(fit))


def test_agglomerative_arguments(blobs):
    with pytest.raises(ValueError):
        ag.fit_agglomerative(blobs, 3, metric="cosine")
    with pytest.raises(ValueError):
        ag.fit_agglomerative(blobs, 500)
    with pytest.raises(ValueError):
        ag.fit_agglomerative(blobs, 3, linkage="average", max_groups=20)


def test_dendrogram_tail(blobs, points):
    merges = plotdata.dendrogram_merges(blobs, last_p=10).orderBy("step").collect()
    whole = ag.merge_summaries(np.ones(120), points[1])
    assert [r["step"] for r in merges] == list(range(110, 119))
    assert np.allclose([r["height"] for r in merges], whole[-9:, 2])
    assert plotdata.dendrogram_merges(blobs, sample_size=30).count() == 29


# --- reduction ----------------------------------------------------------------------------------


@pytest.mark.parametrize("whiten", [False, True])
def test_pca_matches_numpy(blobs, points, whiten):
    x = points[1] + 100.0
    shifted = blobs.withColumn("vector", F.transform("vector", lambda v: v + 100.0))
    fit = pca.fit_pca(shifted, 3, whiten=whiten)
    got = np.array([r["reduced"] for r in fit.transform(shifted).orderBy("doc_id").collect()])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:3] * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    expected = centred @ axes.T
    if whiten:
        expected = expected / (s[:3] / np.sqrt(len(x) - 1))
    assert np.allclose(got, expected, atol=1e-7)
    assert np.allclose(fit.explained_variance_ratio, (s**2 / (s**2).sum())[:3])
    assert np.allclose(fit.components, axes)


def test_covariance_matches_numpy(blobs, points):
    assert np.allclose(pca.covariance_matrix(blobs), np.cov(points[1].T))
    assert pca.covariance(blobs).count() == 10


def test_truncated_svd_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random((60, 30)) * (rng.random((60, 30)) < 0.2)
    x[5] = 0.0
    rows = [(i, Vectors.sparse(30, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["doc_id", "tfidf"]).repartition(3)
    fit = svd.fit_truncated_svd(df, 5, 30, n_iter=25)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(fit.singular_values, s[:5], rtol=1e-6)
    reduced = fit.transform(df)
    got = np.array([r["reduced"] for r in reduced.orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:5].T), atol=1e-4)
    ratio = (x @ vt[:5].T).var(axis=0).sum() / x.var(axis=0).sum()
    assert np.isclose(svd.svd_explained_variance(reduced).first()[0], ratio, atol=1e-5)
    dense_rows = [(i, Vectors.dense(v)) for i, v in enumerate(x)]
    again = svd.fit_truncated_svd(spark.createDataFrame(dense_rows, ["doc_id", "tfidf"]), 5, 30, n_iter=25)
    assert np.allclose(again.singular_values, s[:5], rtol=1e-6)
    with pytest.raises(ValueError):
        svd.fit_truncated_svd(df, 31, 30)


def nearest_sets(x, k):
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(gaps, np.inf)
    return np.argsort(gaps, axis=1, kind="stable")[:, :k]


def test_exact_neighbours(monkeypatch, blobs, points):
    monkeypatch.setattr("corpusweave.operators.blocks.BLOCK_ROWS", 50)
    got = neighbours.knn_graph(blobs, 6).toPandas().sort_values(["src", "rank"])
    assert (got.groupby("src").size() == 5).all()
    assert np.array_equal(got["dst"].to_numpy().reshape(-1, 5), nearest_sets(points[1], 5))


def test_nearest_rows_are_those_of_all_differences(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", (16, 32))
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 7)), rng.normal(size=(90, 7)) * 1e-3 + 1e4  # far from 0: products round away the gaps
    a[:20], a[20:30], b[40:60] = b[:20], 0.0, b[3]  # copies, and ties between them
    a[30, 2], b[70, 1] = np.nan, np.inf
    left, right = np.arange(50), np.concatenate([np.arange(89), [0]])  # id 0 comes twice
    sizes = rng.integers(1, 9, 50).astype(float), rng.integers(1, 9, 90).astype(float)
    with np.errstate(invalid="ignore"):
        gap = merging.gaps(a, b)
        for k, weigh in ((4, None), (1, sizes), (100, None)):
            value = gap if weigh is None else merging.ward_costs(gap, *weigh)
            value = np.where(left[:, None] == right[None, :], np.inf, value)
            want = [(i, int(j), value[i, j]) for i in range(50) for j in np.argsort(value[i], kind="stable")[:k] if np.isfinite(value[i, j])]
            assert [*zip(*(x.tolist() for x in blocks.nearest_rows(a, b, k, left, right, weigh)))] == want


def test_a_row_travels_to_few_blocks(spark):
    assert blocks.search_blocks(spark, 600_000, 64) < 50 < blocks.blocks_for(600_000)
    assert blocks.search_blocks(spark, 600_000, 4_096) == 600  # wide rows: as many blocks as before
    assert blocks.search_blocks(spark, 0, 64) == 1


def test_hashed_neighbours_find_most(blobs, points):
    got = neighbours.knn_graph(blobs, 6, method="hashed", passes=8, run_rows=40).toPandas()
    assert (got.groupby("src").size() == 5).all()
    true = {(i, int(j)) for i, row in enumerate(nearest_sets(points[1], 5)) for j in row}
    assert len(true & set(zip(got["src"], got["dst"]))) / len(true) > 0.8


def test_refined_neighbours_of_vectors_without_groups(spark):
    x = np.random.default_rng(6).normal(size=(3_000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>").repartition(8)
    truth = nearest_sets(x, 9)

    def recall(rounds):
        got = neighbours.knn_graph(rows, 10, method="hashed", passes=3, run_rows=256, rounds=rounds).toPandas()
        assert (got.groupby("src").size() == 9).all()
        true = {(i, int(j)) for i, row in enumerate(truth) for j in row}
        return len(true & set(zip(got["src"], got["dst"]))) / len(true)

    assert recall(0) < 0.85 and recall(6) >= 0.95


def test_new_rows_land_in_their_blob(spark, blobs, points):
    rng = np.random.default_rng(9)
    fitted = blobs.drop("cluster")
    layout = neighbours.spectral_embedding(fitted, 2, n_neighbors=10)
    assert layout.first()["residual"] <= neighbours.TOLERANCE
    fresh = [(i, (rng.normal(0, 0.4, 4) + (0.0, 7.0, -7.0)[i % 3]).tolist()) for i in range(12)]
    new = spark.createDataFrame(fresh, "doc_id bigint, vector array<double>")
    placed = {r["doc_id"]: np.array(r["reduced"]) for r in neighbours.place_new_rows(fitted, layout, new, n_neighbors=10).collect()}
    old = {r["doc_id"]: np.array(r["reduced"]) for r in layout.collect()}
    centers = [np.mean([old[i] for i, c in zip(points[0], points[2], strict=True) if c == g], axis=0) for g in range(3)]
    assert len(placed) == 12
    assert all(np.argmin([np.linalg.norm(p - c) for c in centers]) == i % 3 for i, p in placed.items())


def test_copies_get_full_neighbour_lists(spark):
    rows = [(i, [1.0, 2.0] if i < 60 else [float(i), 0.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, vector array<double>").repartition(4)
    for method in neighbours.METHODS:
        graph = neighbours.knn_graph(df, 5, method=method)
        assert graph.groupBy("src").count().where("count <> 4").count() == 0
        assert graph.where("src < 60 AND distance > 0").count() == 0


def test_membership_strengths(blobs):
    graph = neighbours.knn_graph(blobs, 8)
    edges = neighbours.fuzzy_graph(graph, 8).toPandas()
    weight = {(r.src, r.dst): r.weight for r in edges.itertuples()}
    assert all(abs(weight[b, a] - w) < 1e-12 for (a, b), w in weight.items())
    assert edges["weight"].between(0, 1 + 1e-12).all()
    # One direction only: the strengths of a row add up to log2(k), its nearest has strength 1.
    listed = graph.groupBy("src").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    sums = listed.select(neighbours._strengths(F.col("d"), 8).alias("w")).collect()
    assert all(abs(sum(r["w"]) - 3) < 1e-3 and r["w"][0] == 1 for r in sums)


def test_layout_separates_blobs(blobs, points):
    rows = blobs.drop("cluster")
    layout = neighbours.spectral_embedding(rows, 2, n_neighbors=10)
    assert layout.count() == len(points[0])
    got = layout.select("doc_id", F.col("reduced").alias("vector"))
    found = kmeans.fit_kmeans(got, 3, n_init=5).predict(got)
    assert same_partition(labels_of(found), points[2])


def test_layout_of_a_ring_is_a_circle(spark):
    n = 24
    pairs = [(i, (i + 1) % n) for i in range(n)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")
    rows = neighbours.spectral_layout(edges, 2).orderBy("id").collect()
    x = np.array([r["vector"] for r in rows])
    radius = np.linalg.norm(x, axis=1)
    assert radius.std() / radius.mean() < 1e-3


def test_layout_of_a_path_converges(spark):
    n = 80
    pairs = [(i, i + 1) for i in range(n - 1)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")
    rows = neighbours.spectral_layout(edges, 2, oversampling=3).orderBy("id").collect()
    assert rows[0]["residual"] <= 1e-5
    matrix = np.zeros((n, n))
    for a, b in pairs:
        matrix[a, b] = matrix[b, a] = 1
    degree = matrix.sum(axis=1)
    _, vectors = np.linalg.eigh(matrix / np.sqrt(np.outer(degree, degree)))
    found = np.linalg.qr(np.array([r["vector"] for r in rows]))[0]
    assert np.linalg.svd(found.T @ vectors[:, [-2, -3]])[1].min() > 0.999


def test_large_layouts_are_not_broadcast(spark, monkeypatch):
    """A million numbers are 8 MB in each of several forms on the driver; 615,360 nodes have 5.5 of them."""
    assert neighbours.SMALL_CELLS < 300_000 * 9 and neighbours.SMALL_ROWS < 300_000
    monkeypatch.setattr(neighbours, "SMALL_CELLS", 10)
    monkeypatch.setattr(neighbours, "SMALL_ROWS", 10)
    held = []
    monkeypatch.setattr(neighbours.F, "broadcast", lambda df: held.append(df) or df)
    pairs = [(i, i + 1) for i in range(11)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")
    rows = neighbours.spectral_layout(edges, 2, oversampling=3).collect()
    assert not held and len(rows) == 12 and rows[0]["residual"] <= 1e-5


@pytest.mark.parametrize("cells", [8_000_000, 1_000, 1])
def test_layout_steps_over_blocks_of_nodes(spark, monkeypatch, cells):
    """A round, or a step where a round's broadcasts are too large together, sets down a row per block of nodes;
    broadcast or shuffled, the layout solves its graph."""
    n, held = 80, []
    monkeypatch.setattr(neighbours, "BLOCK_NODES", 20)
    monkeypatch.setattr(neighbours, "MAX_BROADCAST_CELLS", cells)
    if cells == 1:
        monkeypatch.setattr(neighbours, "MAX_BROADCAST_ROWS", 1)

    def counted(df, cut=neighbours.cut_lineage):
        done = cut(df)
        held.append(done.count())
        return done

    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    pairs = [(i, j, 1.0 + (i * j) % 3) for i in range(n) for j in (i + 1, i + 7, i + 31) if j < n]
    odd = [(3, 3, 2.0), (None, 4, 1.0), (5, 200, 1.0)]  # a loop, a null and a node without edges of its own
    edges = spark.createDataFrame([*pairs, *((b, a, w) for a, b, w in pairs), *odd], "src bigint, dst bigint, weight double")
    rows = neighbours.spectral_layout(edges, 2).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(n)) and rows[0]["residual"] <= 1e-5
    assert max(held[1:]) <= 4 and held[0] <= 16
    assert (len(held) - 2) % 9 == 0 or cells != 1_000
    matrix = np.zeros((n, n))
    for a, b, w in pairs:
        matrix[a, b] = matrix[b, a] = w
    loops = matrix.sum(axis=1) + 2.0 * (np.arange(n) == 3) + 1.0 * (np.arange(n) == 5)
    degree = loops + matrix.sum(axis=1)
    _, vectors = np.linalg.eigh((matrix + np.diag(loops)) / np.sqrt(np.outer(degree, degree)))
    found = np.linalg.qr(np.array([r["vector"] for r in rows]))[0]
    assert np.linalg.svd(found.T @ vectors[:, [-2, -3]])[1].min() > 0.999


# --- dense vectors ------------------------------------------------------------------------------


def test_svd_multiplies_a_bounded_number_of_entries(monkeypatch):
    monkeypatch.setattr(svd, "CHUNK_ENTRIES", 10)
    lengths = [3, 0, 4, 4, 25, 0, 0, 2, 9, 1]
    indices = pa.array([list(range(n)) for n in lengths], pa.list_(pa.int32()))
    values = pa.array([[float(i + 1)] * n for i, n in enumerate(lengths)], pa.list_(pa.float64()))
    chunks = [*svd._chunks(indices.slice(1), values.slice(1))]
    assert all(len(c.idx) <= 10 or c.rows == 1 for c in chunks) and sum(c.rows for c in chunks) == 9
    axes = np.random.default_rng(0).normal(size=(25, 3))
    want = np.array([axes[:n].sum(axis=0) * (i + 1) for i, n in enumerate(lengths)])[1:]
    assert np.allclose(np.vstack([c.project(axes) for c in chunks]), want)


def test_encoder_is_built_once_and_fed_small_batches(spark):
    df = spark.createDataFrame([(i, f"w{i} w{i % 3}" if i else None) for i in range(50)], "doc_id bigint, text string").coalesce(1)

    def make():
        state = {"built": 0}

        def encode(texts):
            state["built"] += 1
            assert len(texts) <= 8
            return np.array([[len(t), state["built"]] for t in texts], dtype=float)

        return encode

    rows = dense.dense_encode(df, make, batch_size=8).orderBy("doc_id").collect()
    assert rows[0]["vector"][0] == 0 and rows[-1]["vector"][1] == 7


def test_hashing_encoder_is_deterministic_and_unit_length():
    a = dense.HashingEncoder(16)(["a b c", ""])
    assert np.array_equal(a, dense.HashingEncoder(16)(["a b c", ""]))
    assert np.isclose(np.linalg.norm(a[0]), 1) and not a[1].any()


@pytest.mark.parametrize("small", [True, False])
def test_mean_word_vectors(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(dense, "MAX_BROADCAST_CELLS", 2)
    docs = spark.createDataFrame([(1, "aa aa bb zz"), (2, "zz"), (3, None)], "doc_id bigint, text string")
    words = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [4.0, 3.0])], "term string, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in dense.mean_word_vectors(docs, words).collect()}
    assert np.allclose(got[1], [2.0, 1.0]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_word2vec(docs):
    model, scored = dense.fit_word2vec(docs, width=8, min_count=3)
    assert scored.where(F.size("vector") != 8).count() == 0 and scored.count() == docs.count()


def test_scatter_tables(blobs, caplog):
    both = plotdata.scatter_all(blobs, ["pca", "tsne"])
    assert both.columns == ["doc_id", "x", "y", "cluster", "method"] and "t-SNE" in caplog.text
    with pytest.raises(ValueError):
        plotdata.scatter_all(blobs, ["mds"])
    assert plotdata.scatter_umap(blobs).count() == 120


def test_frequent_keys_are_joined_without_a_shuffle(spark):
    """Of a lookup too large for a broadcast the frequent keys are broadcast, the others shuffled, and no row is lost."""
    from corpusweave.operators import bounds

    facts = spark.createDataFrame([(i, "often" if i % 10 else f"rare{i % 70}") for i in range(2_000)], "doc_id bigint, term string")
    facts = facts.union(spark.createDataFrame([(9_000, "unknown"), (9_001, None)], facts.schema))
    lookup = spark.createDataFrame([("often", 1.0), *((f"rare{i}", 2.0 + i) for i in range(70))], "term string, idf double")
    expected = sorted(map(tuple, facts.join(lookup, "term").select("doc_id", "term", "idf").collect()))
    for frequency in (None, lookup.select("term", F.when(F.col("term") == "often", 1_800).otherwise(3).alias("n"))):
        got = bounds.frequent_join(facts, lookup, "term", F.col("doc_id"), frequency, max_rows=5)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.select("doc_id", "term", "idf").collect())) == expected and len(expected) == 2_000
        assert "Union" in plan and "_salt" in plan
    ties = bounds.frequent_join(facts, lookup, "term", F.col("doc_id"), lookup.select("term", F.lit(7).alias("n")), max_rows=5)
    assert ties.count() == 2_000


def test_word_vector_sums_shuffle_a_row_per_document(spark):
    """Many more documents than the groups after which Spark's object aggregates sort their input."""
    docs = spark.createDataFrame([(i, "aa bb " * 3 + "cc" * (1 + i % 2)) for i in range(1_000)], "doc_id bigint, text string").coalesce(1)
    words = spark.createDataFrame([("aa", [1.0, 2.0]), ("bb", [3.0, 6.0])], "term string, vector array<double>")
    means = dense.mean_word_vectors(docs, words)
    assert "ObjectHashAggregate" not in means._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r["vector"]) for r in means.collect()} == {(2.0, 4.0)}
