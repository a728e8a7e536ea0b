import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusweave.operators import dense
from corpusweave.plans import catalog


@pytest.mark.parametrize("name", ["dense_encode_whole", "dense_encode_hashing"])
def test_every_word_is_encoded(spark, monkeypatch, name):
    seen, encode = [], dense.dense_encode
    monkeypatch.setattr(dense, "dense_encode", lambda docs, *a, **b: seen.append(docs) or encode(docs, *a, **b))
    getattr(catalog, name)(spark, SMALL)
    words = lambda docs: docs.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    want = words(catalog.documents(spark, SMALL)).where("n > 256")
    assert want.count() > 0
    assert sorted(words(seen[0]).where("n > 256").collect()) == sorted(want.collect())


def test_encoding_holds_few_texts_at_a_time(spark):
    def make_encoder():
        import tracemalloc

        tracemalloc.start()
        return lambda texts: [[len(text), tracemalloc.get_traced_memory()[0]] for text in texts]

    text = F.when(F.col("doc_id") % 100 > 0, F.repeat(F.col("doc_id").cast("string"), 5_000))
    docs = spark.range(1_000, 3_000, 1, 1).select(F.col("id").alias("doc_id")).withColumn("text", text)  # 40 MB in one batch
    rows = dense.dense_encode(docs, make_encoder).select("doc_id", "vector").collect()
    assert {r["vector"][0] for r in rows if r["doc_id"] % 100} == {20_000.0} and {r["vector"][0] for r in rows if not r["doc_id"] % 100} == {0.0}
    assert max(r["vector"][1] for r in rows) < 60e6  # the batch as it came, not its texts a second time
