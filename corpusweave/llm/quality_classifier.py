"""Quality scores: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.bytehash import mix, prefix_sums, slices, span_hashes, text_bytes
from corpusweave.session import ship_package

BITS = 18  # 2^18 weights
SAMPLE_ROWS = 16_384  # labelled rows that are learnt from, chosen by a hash of their id
EPOCHS = 3
_SLICE = 1 << 21  # bytes of text that are hashed at a time

# class of each byte: 0 space, 1 letter, digit or non-ASCII, 2 sign; a word is a run of one class
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of every row's distinct hashed words and word pairs; weights are counts
    scaled to unit length."""
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, np.zeros(0)
    kind = _KIND[data]
    fresh = np.r_[True, kind[1:] != kind[:-1]]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.r_[starts[1:], len(data)]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    row = np.searchsorted(offsets, starts, "right") - 1
    word = span_hashes(prefix_sums(data), starts, ends)
    same = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])[same]
    bucket = (np.r_[word, pair] >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((np.r_[row, row[:-1][same]] << bits) | bucket, return_counts=True)
    row, bucket = key >> bits, key & ((1 << bits) - 1)
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(offsets) - 1))
    return row, bucket, count / norm[row]


@dataclass
class FtrlModel:
    """Per-coordinate FTRL-proximal state of a logistic regression; the last coordinate is the bias."""

    weights: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = EPOCHS,
            alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> FtrlModel:
        """``rows``: (buckets, weights, label 0 or 1), visited in the given order in each epoch."""
        size = (1 << bits) + 1
        z, n = np.zeros(size), np.zeros(size)

        def current(at: np.ndarray) -> np.ndarray:
            gain = (beta + np.sqrt(n[at])) / alpha + l2
            return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / gain)

        for _ in range(epochs):
            for at, x, label in rows:
                at, x = np.r_[at, size - 1], np.r_[x, 1.0]
                w = current(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - label) * x
                grown = n[at] + g * g
                z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
                n[at] = grown
        return cls(current(np.arange(size)))

    def score(self, row: np.ndarray, bucket: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        """Probability of label 1 for each row: a sparse dot product and the bias."""
        margin = np.bincount(row, self.weights[bucket] * x, rows) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    bits: int = BITS, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS,
) -> FtrlModel:
    """Fit on at most ``sample_rows`` labelled ids, those with the smallest id hash.

    Ids with a null or two different labels are left out. The chosen ids and labels are broadcast
    (bounded by ``sample_rows``), texts are hashed where they are read, and only the sample's sparse
    rows meet in one task, which visits them in hash order. Without labels all weights are 0.
    """
    ship_package(docs.sparkSession)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).cast("int").alias("_most"))
        .where("_label = _most")
        .withColumn("_order", F.xxhash64(id_col))
        .orderBy("_order", id_col)
        .limit(sample_rows)
        .select(F.col(id_col).alias("_known"), "_label", "_order")
    )
    chosen = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(known), F.col(id_col) == F.col("_known"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, _SLICE):
                own = offsets[a : b + 1]
                row, bucket, x = hashed_ngrams(data[own[0] : own[-1]], own - own[0], bits)
                cuts = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                bucket, x = bucket.astype("<i4"), x.astype("<f4")
                spans = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([bucket[i:j].tobytes() for i, j in spans], pa.binary()),
                        pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()),
                    ],
                    ["_order", "_label", "at", "x"],
                )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for order, label, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((order, at, x, label))
        rows.sort()
        found = FtrlModel.fit([(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4"), y) for _, a, x, y in rows], bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([found.weights.astype("<f4").tobytes()], pa.binary())], ["weights"])

    sparse = chosen.select("_order", "_label", "_text").mapInArrow(hashed, "_order long, _label int, at binary, x binary")
    found = sparse.repartition(1).mapInArrow(trained, "weights binary").collect()
    weights = np.frombuffer(found[0][0], "<f4").astype(float) if found else np.zeros((1 << bits) + 1)
    return FtrlModel(weights)


def score_quality(docs: DataFrame, model: FtrlModel, keep: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The ``keep`` columns of every row with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text has no n-grams and gets the bias alone. The model (2^bits weights) is
    broadcast; nothing is shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model.weights.astype(np.float32))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FtrlModel(shared.value.astype(float))
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            parts = []
            for a, b in slices(offsets, _SLICE):
                part = offsets[a : b + 1]
                found = hashed_ngrams(data[part[0] : part[-1]], part - part[0], bits)
                parts.append(own.score(*found, b - a))
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*keep, "score"])

    source = docs.select(*keep, F.col(text_col).alias("_text"))
    rows = source.mapInArrow(scored, source.select(*keep).schema.add("score", "double"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 as text leaves remainder 1 by 3; those labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
