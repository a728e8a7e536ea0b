"""Every query against its SQL on the smallest tables, and the shape of the main plans."""

import re

import pytest
from check_oracles import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusweave.functions import text as tx
from corpusweave.operators import interpret
from corpusweave.plans import catalog

LAYOUTS = {"umap", "scatter_umap"}  # slow; the layout is tested on graphs with known eigenvectors
ELSEWHERE = re.compile(r"op\d+_|pipeline$")  # tests/llm runs these and counts their rows


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, database, name):
    mine = contract.queries()[name](spark, SMALL).toPandas()
    assert difference(mine, database.sql(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(n for n in set(contract.queries()) - set(contract.oracle_sql()) - LAYOUTS if not ELSEWHERE.match(n)))
def test_gives_rows(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert not set(contract.oracle_sql()) - set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_is_one_narrow_stage(spark):
    docs = catalog.documents(spark, SMALL)
    text = F.col("text")
    for column in (tx.standard_preprocess(text), tx.light_preprocess(text), tx.terms(text), tx.remove_urls(text)):
        plan = plan_of(docs.select("doc_id", column))
        assert "Exchange" not in plan and "Python" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize(
    "name",
    ["term_frequency", "tfidf", "top_keywords", "silhouette", "davies_bouldin", "interpret", "knn_graph", "kmeans_predict"],
)
def test_no_cross_join(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_centroid_join_is_broadcast_and_scan_is_pruned(spark):
    plan = plan_of(interpret.closest_to_centroid(catalog.vectors(spark, SMALL)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    sizes = plan_of(contract.queries()["cluster_sizes"](spark, SMALL))
    assert "ReadSchema: struct<label:int>" in sizes


def test_keyword_ranking_limits_before_the_shuffle(spark):
    plan = plan_of(contract.queries()["cluster_term_weights"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name, shown", [("closest_text", "closest_sample_text"), ("closest_name", "closest_sample_name")])
def test_closest_documents_come_from_all_documents_and_all_embeddings(spark, tmp_path, name, shown):
    texts = ["a", "bb e", "ccc dd", "e e e e e", None]
    spark.createDataFrame([(i, t, f"src{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    points = [(3, [0.0, 1.0], 7), (4, [0.0, 4.0], 7), (1, [9.0, 9.0], 7), (99, [5.0, 5.0], 8), (0, None, 8), (2, [1.0, None], 7)]
    spark.createDataFrame(points, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["kind"], r["cluster"]): (r["doc_id"], r[shown]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == [("embedding", 7), ("embedding", 8), ("text", 0), ("text", 1)]
    assert got["embedding", 7][0] == 4 and got["embedding", 8] == (99, None)


def test_word2vec_check_adds_up_whole_vectors(spark):
    """No row per word and dimension: the check's plan takes no vector apart."""
    assert "posexplode" not in plan_of(contract.queries()["word2vec_means"](spark, SMALL))


def test_svd_check_sums_entries_by_term(spark, monkeypatch):
    """The check of the axes makes a row per entry of the matrix, not per entry and axis, and computes the matrix once."""
    from corpusweave.operators import tfidf
    from corpusweave.plans import invariants

    made, taken = [], []
    vectors, posexplode = tfidf.TfidfModel.vectors, F.posexplode
    monkeypatch.setattr(tfidf.TfidfModel, "vectors", lambda *a, **k: made.append(1) or vectors(*a, **k))
    monkeypatch.setattr(F, "posexplode", lambda column: taken.append(1) or posexplode(column))
    row = invariants.QUERIES["svd_axes"](spark, SMALL).first()
    assert row["orthonormal"] and row["eigen_equation"] and row["lengths_agree"]
    assert len(made) == 1 and len(taken) == 1  # the projections' lengths
