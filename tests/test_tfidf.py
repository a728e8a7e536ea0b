import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import tfidf
from corpusweave.operators.tfidf import TfidfConfig, TfidfModel, fit_tfidf

TEXTS = {
    1: "apple apple pear",
    2: "apple plum x",
    3: "apple pear plum plum",
    4: "",
    5: "only here once",
}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").repartition(3)


def brute(texts, low=1, high=1, min_df=2, max_df=0.95, limit=None):
    counts = {}
    for key, text in texts.items():
        words = re.findall(r"\b\w\w+\b", text.lower())
        counts[key] = Counter(
            " ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)
        )
    n = len(texts)
    df = Counter(t for c in counts.values() for t in c)
    total = sum(counts.values(), Counter())
    most = max_df if isinstance(max_df, int) else max_df * n
    least = min_df if isinstance(min_df, int) else min_df * n
    kept = sorted((t for t in df if least <= df[t] <= most), key=lambda t: (-total[t], t))[:limit]
    out = {}
    for key, c in counts.items():
        raw = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in kept if c[t]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(key, t): v / norm for t, v in raw.items()}
    return sorted(kept), out


CASES = [
    {},
    {"min_df": 1, "max_df": 1.0},
    {"min_df": 1, "max_df": 1},
    {"min_df": 0.3, "max_df": 0.6},
    {"min_df": 1, "max_df": 1.0, "max_features": 3},
    {"min_df": 1, "max_df": 1.0, "ngram_range": (1, 2)},
    {"min_df": 1, "max_df": 1.0, "ngram_range": (2, 3), "max_features": None},
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("joined", [False, True])
def test_weights_match_brute_force(small, case, joined):
    config = TfidfConfig(**case)
    names, expected = brute(
        TEXTS, *config.ngram_range, config.min_df, config.max_df, config.max_features
    )
    model = fit_tfidf(small, config)
    assert model.feature_names == names
    model.small = not joined
    got = {(r[0], r[1]): r[2] for r in model.weights(small).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)


def test_empty_documents_stay(small):
    model = fit_tfidf(small)
    vectors = {r["doc_id"]: r["tfidf"] for r in model.vectors(small).collect()}
    assert vectors[4].numNonzeros() == 0 and len(vectors) == 5
    for bounded in (True, False):
        model.small = bounded
        rows = model.weights(small, keep_empty=True).where("term IS NULL AND weight = 0").collect()
        assert sorted(r["doc_id"] for r in rows) == [4, 5]


def test_unit_length_whatever_the_partitioning(docs):
    model = fit_tfidf(docs)
    norms = model.weights(docs).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms.collect())
    again = fit_tfidf(docs.repartition(2).orderBy(F.rand(3)))
    assert again.feature_names == model.feature_names


def test_numbering_without_a_bound(spark, docs):
    counts = tfidf.document_frequency(tfidf.term_frequency(tfidf.document_terms(docs)))
    numbered = tfidf.with_term_index(counts, bounded=False).orderBy("term_index").collect()
    assert [r["term_index"] for r in numbered] == list(range(len(numbered)))
    names = [r["term"].encode() for r in numbered]
    assert names == sorted(names)


def test_save_and_load(spark, small, tmp_path):
    model = fit_tfidf(small, TfidfConfig(ngram_range=(1, 2), min_df=1))
    model.save(str(tmp_path / "m"))
    again = TfidfModel.load(spark, str(tmp_path / "m"))
    assert again.config.ngram_range == (1, 2) and again.n_docs == 5
    assert sorted(again.weights(small).collect()) == sorted(model.weights(small).collect())


def test_shape_and_errors(small):
    model = fit_tfidf(small)
    shape = model.shape(small).first()
    assert (shape["n_docs"], shape["n_terms"]) == (5, len(model.feature_names))
    with pytest.raises(ValueError):
        fit_tfidf(small, TfidfConfig(min_df=5)).vectors(small)
    with pytest.raises(ValueError):
        tfidf.within_df_bounds(small, 5, 1, 1.5)


def test_vectors_move_no_documents(docs):
    model = fit_tfidf(docs)
    source = docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = model.vectors(source.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    counting = tfidf.term_frequency(tfidf.document_terms(source))
    assert "Exchange" not in counting._jdf.queryExecution().executedPlan().toString()


def test_feature_order_is_vector_order(small):
    model = fit_tfidf(small, TfidfConfig(min_df=1, max_df=1.0))
    row = model.vectors(small.where("doc_id = 2")).first()["tfidf"]
    assert [model.feature_names[i] for i in row.indices] == ["apple", "plum"]
    assert np.isclose(np.linalg.norm(row.toArray()), 1.0)
