"""Queries that hold a fitted result against what must be true of it, and the SQL that says so.

Fitted numbers (axes, labels, layouts) have no SQL of their own, but sums over them have: a query here
fits on the whole table and returns such sums, its SQL computes the same from the table alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.functions import vectors as vx
from corpusweave.operators import agglomerative as ag
from corpusweave.operators import dense, evaluate, gmm, interpret, kmeans, neighbours, pca, plotdata, sampling, svd, tfidf
from corpusweave.operators.bounds import spread
from corpusweave.plans import presets
from corpusweave.plans.catalog import Query, documents, rounded, run_whole, spread_documents, vectors
from corpusweave.session import set_down, ship_package

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CELLS = "cells AS (SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value, label FROM embeddings)"
TOTAL = "(SELECT sum(s) FROM (SELECT var_pop(value) * count(*) AS s FROM cells GROUP BY idx))"


def invariant(sql: str):
    def register(run: Query) -> Query:
        def prepared(spark, sf_dir):
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[run.__name__] = prepared
        ORACLES[run.__name__] = sql
        return run

    return register


def _squares(rows: DataFrame, cluster: str | None = None) -> float:
    """Sum of squared distances to the mean of all rows or of the own cluster."""
    cells = rows.select(*([cluster] if cluster else []), F.posexplode("vector").alias("idx", "value"))
    keys = ["idx", cluster] if cluster else ["idx"]
    return cells.groupBy(*keys).agg((F.var_pop("value") * F.count("value")).alias("s")).agg(F.sum("s")).first()[0]


def _near(value: Column | float, other: float) -> Column:
    """Whether two sums agree to nine digits."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.abs(value - other) <= 1e-9 * max(1.0, abs(other))


# --- reduction ----------------------------------------------------------------------------------


@invariant(f"""WITH {CELLS} SELECT count(DISTINCT idx) AS n_axes, round({TOTAL} / (count(DISTINCT vec_id) - 1), 6) + 0.0 AS total_variance,
    true AS shares_add_up, 0.0::DOUBLE AS largest_residual, true AS uncorrelated FROM cells""")
def pca_axes(spark, sf_dir):
    """All axes: eigenvectors of the covariance, their projections uncorrelated, variances adding up."""
    rows = vectors(spark, sf_dir)
    width = rows.select(F.size("vector")).first()[0]
    fitted = pca.fit_pca(rows, width)
    matrix = pca.covariance_matrix(rows)
    own = fitted.components @ matrix @ fitted.components.T
    residual = np.abs(matrix @ fitted.components.T - fitted.components.T * np.diag(own)).max()
    reduced = fitted.transform(rows).select(F.posexplode("reduced").alias("idx", "value"))
    variance = reduced.groupBy("idx").agg(F.var_samp("value").alias("v")).agg(F.count("*").alias("n_axes"), F.sum("v").alias("total_variance"))
    shares = abs(fitted.explained_variance_ratio.sum() - 1) < 1e-9 and np.allclose(fitted.explained_variance_ratio * np.trace(matrix), np.diag(own))
    apart = np.abs(own - np.diag(np.diag(own))).max() < 1e-9
    return rounded(
        variance.select("n_axes", "total_variance", F.lit(bool(shares)).alias("shares_add_up"), F.round(F.lit(float(residual)), 8).alias("largest_residual"), F.lit(bool(apart)).alias("uncorrelated")),
        "total_variance",
    )


@invariant("SELECT 'pca' AS method, count(*) AS n_points, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y, 0.0::DOUBLE AS covariance, true AS x_is_wider FROM embeddings")
def scatter_axes(spark, sf_dir):
    """Plotted points are centred and uncorrelated, the first axis the wider one; t-SNE is left out."""
    both = plotdata.scatter_all(vectors(spark, sf_dir), ["pca", "tsne"])
    sums = both.groupBy("method").agg(
        F.count("*").alias("n_points"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.covar_samp("x", "y").alias("covariance"),
        (F.var_samp("x") >= F.var_samp("y")).alias("x_is_wider"),
    )
    return rounded(sums, "mean_x", "mean_y", "covariance")


@invariant("SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label")
def scatter_pca_sizes(spark, sf_dir):
    """Every row is plotted once, with its own label."""
    return plotdata.scatter_pca(vectors(spark, sf_dir)).where("x is not null and y is not null").groupBy("cluster").agg(F.count_distinct("doc_id").alias("size"))


@invariant("SELECT count(*) AS n_docs, true AS orthonormal, true AS eigen_equation, true AS lengths_agree FROM documents")
def svd_axes(spark, sf_dir):
    """Axes are orthonormal, A'Av = s^2 v but for a thousandth of the largest square, and the projections' squares add up to s^2."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    model = tfidf.fit_tfidf(docs)
    rows = set_down(model.vectors(docs).select("doc_id", "tfidf"), "tfidf")
    fitted = svd.fit_truncated_svd(rows, 10, model.n_terms, n_iter=12)
    reduced = set_down(fitted.transform(rows).select("doc_id", "tfidf", "reduced"), "reduced")
    sums = F.array(*[F.sum(F.col("weight") * F.get("reduced", axis)) for axis in range(10)])  # a row per entry, not per entry and axis
    moved = np.zeros_like(fitted.components)
    for row in tfidf.entries(reduced, "tfidf", ["reduced"]).groupBy("term_index").agg(sums.alias("sums")).toArrow().to_pylist():  # as large as the axes
        moved[row["term_index"]] = row["sums"]
    squares = fitted.singular_values**2
    residual = np.linalg.norm(moved - fitted.components * squares, axis=0).max() / squares[0]
    unit = np.abs(fitted.components.T @ fitted.components - np.eye(10)).max()
    lengths = reduced.select(F.posexplode("reduced").alias("axis", "value")).groupBy("axis").agg(F.sum(F.col("value") * F.col("value")).alias("s")).orderBy("axis").collect()
    agree = np.allclose([r["s"] for r in lengths], squares, rtol=1e-6)
    return reduced.agg(F.count("*").alias("n_docs")).select("n_docs", F.lit(bool(unit < 1e-9)).alias("orthonormal"), F.lit(bool(residual < 1e-3)).alias("eigen_equation"), F.lit(bool(agree)).alias("lengths_agree"))


def _first_terms_share(n: int) -> str:
    from corpusweave.plans.oracles import PLAIN, WEIGHTS, _tf, _vocab

    return f"""WITH {_tf(PLAIN)}, {_vocab()}, {WEIGHTS},
    cols AS (SELECT term, sum(weight) AS s, sum(weight * weight) AS q FROM w GROUP BY term),
    spread AS (SELECT term, q / (SELECT n FROM n) - (s / (SELECT n FROM n)) * (s / (SELECT n FROM n)) AS v FROM cols),
    firsts AS (SELECT term FROM spread ORDER BY term LIMIT {n})
    SELECT round(sum(v) FILTER (term IN (SELECT term FROM firsts)) / sum(v), 6) + 0.0 AS explained_variance_ratio FROM spread"""


@invariant(_first_terms_share(25))
def svd_explained_given_axes(spark, sf_dir):
    """With the first terms themselves as axes, the share is that of their columns' variance."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "text")
    model = tfidf.fit_tfidf(docs)
    fitted = svd.SvdFit(np.eye(model.n_terms, 25), np.ones(25))
    return rounded(svd.svd_explained_variance(fitted.transform(model.vectors(docs))), "explained_variance_ratio")


@invariant("SELECT count(*) AS n_rows, 2 AS width, true AS converged, true AS solves_the_graph FROM embeddings")
def spectral_residual(spark, sf_dir):
    """The layout solves the eigenvalue equation of its graph, measured on the edges themselves."""
    edges = set_down(neighbours.fuzzy_graph(neighbours.knn_graph(vectors(spark, sf_dir), 15), 15), "edges")
    layout = set_down(neighbours.spectral_layout(edges, 2), "layout")
    degree = edges.where("src <> dst").groupBy("src").agg(F.sum("weight").alias("degree"))
    at = layout.join(degree, F.col("id") == F.col("src")).select("id", "degree", F.posexplode("vector").alias("axis", "x"))
    near = at.select(F.col("id").alias("dst"), "axis", (F.col("x") / F.sqrt("degree")).alias("y"))
    moved = edges.where("src <> dst").join(near, "dst").groupBy(F.col("src").alias("id"), "axis").agg(F.sum(F.col("weight") * F.col("y")).alias("moved"))
    both = at.join(moved, ["id", "axis"]).withColumn("moved", F.col("moved") / F.sqrt("degree"))
    sums = both.groupBy("axis").agg(F.sum(F.col("moved") * F.col("x")).alias("mx"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("moved") * F.col("moved")).alias("mm"))
    off = sums.agg(F.max(F.sqrt(F.greatest(F.col("mm") / F.col("xx") - (F.col("mx") / F.col("xx")) ** 2, F.lit(0.0))))).scalar()
    return layout.agg(F.count("*").alias("n_rows"), F.max(F.size("vector")).alias("width"), (F.max("residual") <= 1e-5).alias("converged")).withColumn("solves_the_graph", off < 1e-4)


# --- clustering ---------------------------------------------------------------------------------


@invariant("SELECT count(*) AS n_rows, 10::BIGINT AS n_clusters, 0::BIGINT AS n_moved FROM embeddings")
def kmeans_fixed_point(spark, sf_dir):
    """At the end no row is nearer to another cluster's mean than to its own."""
    rows = set_down(spread(vectors(spark, sf_dir).drop("cluster")), "rows")
    labelled = set_down(kmeans.fit_kmeans(rows, 10, n_init=2, tol=0.0).predict(rows), "labelled")
    again = kmeans.predict_with_centers(labelled, interpret.centroids(labelled), output="nearest")
    return again.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.count(F.when(F.col("cluster") != F.col("nearest"), 1)).alias("n_moved"))


WARD = f"WITH {CELLS} SELECT count(DISTINCT vec_id) AS n_rows, 15::BIGINT AS n_clusters, round({TOTAL}, 6) + 0.0 AS squares, true AS inside_agrees FROM cells"


def _ward_sums(rows: DataFrame, fit: ag.AgglomerativeFit, inside_groups: float) -> DataFrame:
    labelled = rows.join(fit.labels, "doc_id")
    steps = set_down(fit.merges, "merges")
    halves = F.col("height") * F.col("height") / 2
    own = steps.orderBy("step").limit(fit.n_groups - 15).agg(F.sum(halves)).first()[0]
    total = steps.agg(F.sum(halves)).first()[0]
    inside = _squares(labelled, "cluster")
    counts = labelled.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"))
    return rounded(counts.withColumns({"squares": F.lit(total + inside_groups), "inside_agrees": _near(inside, own + inside_groups)}), "squares")


@invariant(WARD)
def agglomerative_squares(spark, sf_dir):
    """Half the squared Ward heights add up to the rows' squares, those below the cut to the squares inside the clusters."""
    rows = vectors(spark, sf_dir).drop("cluster")
    return _ward_sums(rows, ag.fit_agglomerative(rows, 15), 0.0)


@invariant(WARD)
def agglomerative_grouped_squares(spark, sf_dir):
    """The same with groups, to which their own squares are added."""
    rows = set_down(spread(vectors(spark, sf_dir)).drop("cluster"), "rows")
    members, groups = ag.summarise(rows, 100, n_init=1)
    fit = ag.fit_agglomerative(rows, 15, max_groups=100, n_init=1)
    assert groups.count() == fit.n_groups
    return _ward_sums(rows, fit, _squares(rows.join(members, "doc_id"), "group"))


@invariant("""WITH sample AS (SELECT * FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 300),
    cells AS (SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM sample)
    SELECT count(DISTINCT vec_id) - 1 AS n_merges, count(DISTINCT vec_id) AS top_size, true AS ascending, round((SELECT sum(s) FROM
        (SELECT var_pop(value) * count(*) AS s FROM cells GROUP BY idx)), 6) + 0.0 AS squares FROM cells""")
def dendrogram_squares(spark, sf_dir):
    """All merges of the sample: heights ascend, the last holds all rows, half their squares add up."""
    merges = set_down(plotdata.dendrogram_merges(vectors(spark, sf_dir), last_p=300), "merges")
    by_step = F.array_sort(F.collect_list(F.struct("step", "height")))
    sums = merges.agg(
        F.count("*").alias("n_merges"), F.max("size").alias("top_size"), (by_step["height"] == F.array_sort(F.collect_list("height"))).alias("ascending"),
        F.sum(F.col("height") * F.col("height") / 2).alias("squares"),
    )
    return rounded(sums, "squares")


@invariant("SELECT kind, 5::BIGINT AS n_components, 1.0::DOUBLE AS weights, true AS likelihood_grows, count(*) AS n_rows FROM embeddings, (SELECT unnest(['diag', 'full']) AS kind) GROUP BY kind")
def gmm_likelihood(spark, sf_dir):
    """Each step of EM on all dimensions raises the likelihood; weights add up to one; every row gets a component."""
    rows = set_down(vectors(spark, sf_dir).drop("cluster"), "rows")
    found = []
    for kind in ("diag", "full"):
        fitted = gmm.fit_gmm(rows, 5, covariance_type=kind, max_iter=8)
        steps = np.array(fitted.log_likelihoods)
        grows = bool((np.diff(steps) >= -1e-6 * np.abs(steps[:-1])).all())
        n = fitted.predict(rows).where("cluster is not null").count()
        found.append((kind, len(fitted.mixture.weights), round(float(fitted.mixture.weights.sum()), 9), grows, n))
    return spark.createDataFrame(found, "kind string, n_components bigint, weights double, likelihood_grows boolean, n_rows bigint")


# --- dense vectors ------------------------------------------------------------------------------


@invariant("SELECT count(*) AS n_docs, 32 AS width, 0::BIGINT AS n_off FROM documents")
def word2vec_means(spark, sf_dir):
    """A document's vector is the mean of the vectors of its words that the model knows, over all its words."""
    docs = set_down(spread_documents(spark, sf_dir).select("doc_id", "text"), "docs")
    model, scored = dense.fit_word2vec(docs, width=32)
    words = set_down(model.getVectors().select(F.col("word").alias("term"), vx.to_dense(F.col("vector")).alias("vector")), "words")
    tokens = tx.terms(F.coalesce("text", F.lit("")))
    grams = docs.select("doc_id", tokens.alias("grams")).select(F.struct("doc_id", F.size("grams").alias("n")).alias("key"), "grams")
    sums = dense.word_vector_sums(tfidf.term_frequency(grams, "key"), words, 32, "key").select("key.*", "total")
    checked = scored.select("doc_id", "vector").join(sums, "doc_id", "left")
    expected = F.coalesce(F.transform("total", lambda v: v / F.col("n")), F.array_repeat(F.lit(0.0), 32))
    off = checked.where(F.exists(F.zip_with("vector", expected, lambda a, b: F.abs(a - b) > 1e-5), lambda wrong: wrong))
    n_off = off.agg(F.count_distinct("doc_id")).scalar()
    return scored.agg(F.count("*").alias("n_docs"), F.max(F.size("vector")).alias("width")).withColumn("n_off", n_off)


# --- whole experiments --------------------------------------------------------------------------


@invariant("SELECT name, 15::BIGINT AS n_clusters, count(*) AS n_docs, true AS named FROM documents, (SELECT 'dense_ward' AS name) GROUP BY name")
def preset_sizes(spark, sf_dir):
    """The clusters of a preset hold every document once and each shows one of its documents."""
    summary = set_down(run_whole(spark, sf_dir, presets.DENSE_WARD, make_encoder=lambda: dense.HashingEncoder(128)), "summary")
    shown = summary.join(documents(spark, sf_dir), F.col("closest_sample_index") == F.col("doc_id"), "left")
    sums = shown.agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_docs"), F.bool_and(F.col("closest_sample_name").eqNullSafe(F.col("source"))).alias("named"))
    return sums.select(F.lit("dense_ward").alias("name"), "n_clusters", "n_docs", "named")
