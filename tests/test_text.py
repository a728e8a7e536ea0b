import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.operators.lemmas import lemmatize_by_table
from corpusweave.sources.corpus import has_urls

ODD = [
    None,
    "",
    "   ",
    " \t\n",
    " ",
    "\x1c ",
    "don't stop!",
    "«quotes» — and    gaps\n",
    string.punctuation,
    "Élan d'Œuvre ÀÉ 42_x",
    "the cat IS on The mat",
    "a",
]


def apply(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string")
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def python_tokens(text):
    text = (text or "").lower().translate(str.maketrans("", "", string.punctuation))
    return text.split()


def test_blank_and_null(spark):
    assert apply(spark, ODD, tx.blank_to_empty(F.col("text")))[:6] == [""] * 6
    assert apply(spark, ODD, tx.null_to_empty(F.col("text")))[:3] == ["", "", "   "]


def test_punctuation_leaves_no_gap(spark):
    out = apply(spark, ODD, tx.strip_punct(F.col("text")))
    assert out[6] == "dont stop" and out[8] == "" and out[7].startswith("«quotes»")


def test_collapse_matches_python(spark):
    out = apply(spark, ODD, tx.collapse_ws(F.col("text")))
    assert out[1:] == [re.sub(r"\s+", " ", t).strip() for t in ODD[1:]]


def test_standard_matches_python(spark):
    stop = set(tx.ENGLISH)
    expected = [" ".join(w for w in python_tokens(t) if w not in stop) for t in ODD]
    assert apply(spark, ODD, tx.standard_preprocess(F.col("text"))) == expected
    limited = apply(spark, ODD, tx.standard_preprocess(F.col("text"), token_limit=2))
    assert limited == [" ".join(e.split()[:2]) for e in expected]


def test_stopwords_are_case_sensitive_and_keep_repeats(spark):
    tokens = tx.tokenize_ws(F.col("text"))
    out = apply(spark, ["The the cat cat"], tx.join_tokens(tx.remove_stopwords(tokens)))
    assert out == ["The cat cat"]


def test_light_keeps_whitespace_unless_asked(spark):
    texts = [None, "  A  b ", "x, y\n z"]
    assert apply(spark, texts, tx.light_preprocess(F.col("text"))) == ["", "  A  b ", "x, y\n z"]
    strict = tx.light_preprocess(F.col("text"), lower=True, remove_punctuation=True, token_limit=2)
    assert apply(spark, texts, strict) == ["", "a b", "x y"]


def test_token_limit_below_minus_one_is_refused():
    with pytest.raises(ValueError):
        tx.truncate_tokens(F.lit("x"), -2)


def test_terms_and_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    out = [sorted(r[0]) for r in df.select(tx.ngrams(F.col("t"), 1, 3)).collect()]
    assert out == [["a", "a b", "a b c", "b", "b c", "c"], ["a"], []]
    assert [r[0] for r in df.select(tx.ngrams(F.col("t"), 2, 2)).collect()] == [["a b", "b c"], [], []]
    assert apply(spark, ["Élan à d'œuvre x 1y"], tx.terms(F.col("text"))) == [["élan", "œuvre", "1y"]]


def test_urls(spark):
    texts = ["see https://a.b/c?d and http://e", None, "none"]
    assert apply(spark, texts, tx.contains_url(F.col("text"))) == [True, False, False]
    assert apply(spark, texts, tx.remove_urls(F.col("text")))[0] == "see  and "
    df = spark.createDataFrame([("x",), (None,)], "text string")
    assert has_urls(df).first()[0] is False


@pytest.mark.parametrize("join", [False, True])
def test_lemma_table(spark, monkeypatch, join):
    if join:
        monkeypatch.setattr("corpusweave.operators.lemmas.MAX_BROADCAST_ROWS", 1)
    rows = [(1, ["cats", "and", "cats"]), (2, []), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>").repartition(3)
    lemmas = spark.createDataFrame([("cats", "cat"), ("is", "be")], "form string, lemma string")
    out = lemmatize_by_table(docs, lemmas).orderBy("doc_id").collect()
    assert [r["tokens"] for r in out] == [["cat", "and", "cat"], [], []]


def test_literal_lemmas(spark):
    tokens = tx.lemmatize(tx.tokenize_ws(F.col("text")), {"is": "be"})
    assert apply(spark, ["it is so"], tokens) == [["it", "be", "so"]]
    with pytest.raises(ValueError):
        tx.lemmatize(F.lit(""), {str(i): "x" for i in range(501)})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \t\n.,!é'Z ", max_size=30), min_size=1, max_size=20))
def test_cleaning_properties(spark, texts):
    plain = tx.standard_preprocess(F.col("text"), stopwords=None)
    once = apply(spark, texts, plain)
    assert once == [" ".join(python_tokens(t)) for t in texts]
    assert apply(spark, once, plain) == once
