"""Dense document vectors: batch inference, ready-made vectors, and averaged word vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.functions.vectors import list_column, to_dense, to_double
from corpusweave.operators.bounds import MAX_BROADCAST_CELLS, frequent_join
from corpusweave.operators.tfidf import term_frequency
from corpusweave.session import set_down, ship_package

Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """A deterministic stand-in for a sentence model: signed word hashing, unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in enumerate(texts):
            codes = np.array([zlib.crc32(word.encode()) for word in text.split()], dtype=np.int64)
            np.add.at(out[row], (codes >> 1) % self.width, np.where(codes & 1, 1.0, -1.0))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def dense_encode(
    docs: DataFrame,
    make_encoder: Callable[[], Encoder],
    *,
    batch_size: int = 64,
    text: str = "text",
    output: str = "vector",
) -> DataFrame:
    """Encode texts with a user's model, built once per Python worker and fed small batches."""

    ship_package(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:
            # Only the texts handed to the encoder are Python strings at any time.
            vectors = [pa.array([], pa.list_(pa.float64()))]
            for start in range(0, len(texts), batch_size):
                some = [text or "" for text in texts.slice(start, batch_size).to_pylist()]
                vectors.append(list_column(np.asarray(encoder(some), dtype=float)))
            yield pa.concat_arrays(vectors)

    return docs.withColumn(output, encode(F.col(text)))


def precomputed_embeddings(
    docs: DataFrame,
    vectors: DataFrame,
    *,
    key: str = "doc_id",
    vector_key: str = "vec_id",
    vector: str = "embedding",
    output: str = "vector",
    missing: str = "keep",
) -> DataFrame:
    """Attach ready-made vectors by id; both keys are unique, so the join cannot skew.

    ``missing`` says what becomes of a document without a vector: ``keep`` it with null, ``drop`` it,
    or raise an ``error`` when it is read.
    """
    if missing not in ("keep", "drop", "error"):
        raise ValueError("missing must be 'keep', 'drop' or 'error'")
    ready = vectors.select(F.col(vector_key).alias(key), to_double(F.col(vector)).alias(output))
    joined = docs.join(ready, key, "inner" if missing == "drop" else "left")
    if missing == "error":
        told = F.raise_error(F.concat(F.lit("no vector for document "), F.col(key).cast("string")))
        joined = joined.withColumn(output, F.coalesce(output, told.cast("array<double>")))
    return joined


def fit_word2vec(
    docs: DataFrame,
    *,
    width: int = 64,
    min_count: int = 5,
    max_iter: int = 1,
    seed: int = 42,
    text: str = "text",
    output: str = "vector",
) -> tuple[Word2VecModel, DataFrame]:
    """Train word vectors on the corpus; documents get the mean of their words' vectors."""
    words = docs.withColumn("_words", tx.terms(F.coalesce(F.col(text), F.lit(""))))
    model = Word2Vec(
        vectorSize=width,
        minCount=min_count,
        maxIter=max_iter,
        numPartitions=docs.sparkSession.sparkContext.defaultParallelism,
        seed=seed,
        inputCol="_words",
        outputCol="_mean",
    ).fit(words)
    scored = model.transform(words).withColumn(output, to_dense(F.col("_mean")))
    return model, scored.drop("_words", "_mean")


def mean_word_vectors(
    docs: DataFrame,
    word_vectors: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    output: str = "vector",
) -> DataFrame:
    """``(doc_id, vector)``: mean of the given ``(term, vector)`` over each document's known words.

    Words are counted inside the document first, so repeats do not travel. A document without a
    known word gets the zero vector.
    """
    grams = docs.select(key, tx.terms(F.coalesce(F.col(text), F.lit(""))).alias("grams"))
    words = set_down(word_vectors.select("term", "vector"), "words")
    width = words.select(F.size("vector")).first()[0]
    sums = word_vector_sums(term_frequency(grams, key), words, width, key)
    means = sums.select(key, F.transform("total", lambda v: v / F.col("n_known")).alias(output))
    zero = F.array_repeat(F.lit(0.0), width)
    return docs.select(key).join(means, key, "left").withColumn(output, F.coalesce(output, zero))


def word_vector_sums(counts: DataFrame, words: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """``(key, n_known, total)``: occurrences of known ``words`` (term, vector) among ``counts`` (key, term,
    tf), and the sum of their vectors. A document's rows are added up where they are made."""
    known = frequent_join(counts, words, "term", F.xxhash64(key), max_rows=MAX_BROADCAST_CELLS // width)
    cells = [F.sum(F.col("tf") * F.get("vector", i)) for i in range(width)]
    return known.groupBy(key).agg(F.sum("tf").alias("n_known"), F.array(*cells).alias("total"))
