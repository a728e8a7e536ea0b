"""Language identification: a small convolutional network over bytes, trained and applied in NumPy.

Texts are cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of several widths slide over
them, the largest response of each filter (ReLU, max pooling) feeds a softmax over the learnt languages.
A filter of width w is applied as w lookups: embedding times filter slice gives one row per byte value.
The windows' probabilities, weighted by their bytes, give the answer for the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.bytehash import text_bytes
from corpusweave.session import ship_package

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 24  # of each width
EMBEDDING = 12  # numbers per byte value
SAMPLE_ROWS = 8_192  # labelled texts that are learnt from, those whose ids have the smallest hashes
EPOCHS = 8
BATCH = 64  # windows in one step of training, and in one block of scoring
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Embedding (256 x e), one filter bank (width x e x filters) per width with its bias, and the softmax."""

    languages: list[str]
    params: list[np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        banks = [x for w in WIDTHS for x in (rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)), np.zeros(FILTERS))]
        pooled = len(WIDTHS) * FILTERS
        dense = [rng.normal(0, pooled**-0.5, (pooled, len(languages))), np.zeros(len(languages))]
        return cls(languages, [x.astype(np.float32) for x in (rng.normal(0, 1, (256, EMBEDDING)), *banks, *dense)])

    def tables(self) -> list[np.ndarray]:
        """For each width: (width, 256, filters), the response of each filter slice to each byte."""
        return [np.einsum("be,wef->wbf", self.params[0], self.params[1 + 2 * i]) for i in range(len(WIDTHS))]

    def pooled(self, windows: np.ndarray, tables: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses (rows x all filters), and where each was found if ``places`` is set."""
        found, at = [], []
        for i, (width, table) in enumerate(zip(WIDTHS, tables, strict=True)):
            span = windows.shape[1] - width + 1
            total = table[0].take(windows[:, :span], axis=0)
            for k in range(1, width):
                total += table[k].take(windows[:, k : k + span], axis=0)
            if places:
                at.append(total.argmax(axis=1))
            found.append(np.maximum(total.max(axis=1) + self.params[2 + 2 * i], 0))
        return np.concatenate(found, axis=1), at

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.params[-2] + self.params[-1]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross-entropy; only the place of each largest response passes one on."""
        pooled, at = self.pooled(windows, self.tables(), places=True)
        gap = self.softmax(pooled)
        gap[np.arange(len(labels)), labels] -= 1
        gap *= (weights / weights.sum())[:, None]
        result = [np.zeros_like(p) for p in self.params]
        result[-2], result[-1] = pooled.T @ gap, gap.sum(axis=0)
        back = (gap @ self.params[-2].T) * (pooled > 0)
        rows = np.arange(len(windows))[:, None]
        for i, width in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            result[2 + 2 * i] = own.sum(axis=0)
            for k in range(width):
                seen = np.zeros((256, FILTERS), np.float32)
                np.add.at(seen, (windows[rows, at[i] + k], np.arange(FILTERS)), own)
                result[1 + 2 * i][k] = self.params[0].T @ seen
                result[0] += seen @ self.params[1 + 2 * i][k].T
        return result

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 2e-3, seed: int = 0) -> None:
        """Adam over shuffled batches. Each window is also shown cut to a random length, for short texts, and
        both in capitals a quarter of the times; rare languages weigh as much as frequent ones."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weights = (1 / share)[labels]
        capitals = np.stack([_fill(w.tobytes().rstrip(b"\0").decode(errors="ignore").upper().encode()) for w in windows])
        first, second, step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH // 2):
                own = order[a : a + BATCH // 2]
                seen = np.where(rng.random((len(own), 1)) < 0.25, capitals[own], windows[own])
                cut = seen * (np.arange(WINDOW) < rng.integers(8, WINDOW, (len(own), 1)))
                both = np.concatenate([seen, cut.astype(np.uint8)])
                step += 1
                for p, g, m, v in zip(self.params, self.gradients(both, np.tile(labels[own], 2), np.tile(weights[own], 2)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _fill(window: bytes) -> np.ndarray:
    return np.frombuffer(window[:WINDOW].ljust(WINDOW, b"\0"), np.uint8)


def in_windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (the last of each filled up with zeros), whose they are, and their bytes."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    filled = np.minimum(lengths[row] - nth * size, size)
    windows = np.zeros((len(row), size), np.uint8)
    windows[np.arange(size) < filled[:, None]] = data  # row by row, as the texts lie
    return windows, row, filled


def fit_languages(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS
) -> ByteNetwork:
    """Learn from at most ``sample_rows`` labelled texts, those with the smallest hash of their id.

    Each gives one window, chosen by the hash, so that at most sample_rows * WINDOW bytes meet in the one
    task that trains. Rows without language or without a letter are not learnt from. Languages stand in
    alphabetical order; reruns give the same network. Without labelled rows no language is known.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = F.col(text_col).cast("binary")
    nth = F.pmod(F.col("_order"), F.greatest(F.lit(1), F.ceil(F.length("_body") / WINDOW)))
    known = (
        docs.where(F.col(lang_col).isNotNull())
        .select(F.xxhash64(id_col).alias("_order"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), body.alias("_body"))
        .withColumn("_window", F.substring("_body", (nth * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    )
    # a histogram of the leading bits of the hashes, which reads no texts, leaves little more than the sample to be sorted
    step = F.shiftrightunsigned("_order", 52)
    histogram = known.select(step.alias("step")).groupBy("step").count()
    running = F.sum("count").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 4,096 rows
    cut = histogram.withColumn("reached", running).where(F.col("reached") >= sample_rows).agg(F.min("step")).scalar()
    order = F.struct(F.shiftrightunsigned("_order", 1), "_order", "_lang", "_window")
    sample = (
        known.where(step <= F.coalesce(cut, F.lit(1 << 12)))
        .where(has_letter(F.col("_text")))
        .select("_order", "_lang", "_window")
        .orderBy(order)
        .limit(sample_rows)
    )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not rows:
            return
        languages = sorted({lang for _, lang, _ in rows})
        windows = np.stack([_fill(window) for _, _, window in rows])
        network = ByteNetwork.fresh(languages)
        network.train(windows, np.searchsorted(languages, [lang for _, lang, _ in rows]), epochs)
        parts = [p.astype("<f4") for p in network.params]
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages], pa.list_(pa.string())), pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary())), pa.array([[list(p.shape) for p in parts]], pa.list_(pa.list_(pa.int32())))],
            ["languages", "parts", "shapes"],
        )

    found = sample.repartition(1).mapInArrow(trained, "languages array<string>, parts array<binary>, shapes array<array<int>>").collect()
    if not found:
        return ByteNetwork([], [])
    languages, parts, shapes = found[0]
    return ByteNetwork(list(languages), [np.frombuffer(p, "<f4").reshape(s) for p, s in zip(parts, shapes, strict=True)])


def has_letter(text: Column) -> Column:
    """Whether a text holds a letter of any script; null has none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def detect_language(docs: DataFrame, network: ByteNetwork, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``.

    lang_pred is the learnt language with the largest mean probability over all windows of the whole
    text, score that mean; ties go to the first in alphabetical order. A text that is null or has no
    letter is ``und`` with score 0, as is every text if no language is known. Null and repeated ids are
    kept row by row, names in ``keep`` may be any but the two results', the empty table gives no rows.
    The network (a few tens of kilobytes) is broadcast; nothing is shuffled, and a worker holds one batch.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(network)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net.languages else []
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            lettered = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False) & bool(net.languages)
            total = np.zeros((batch.num_rows, max(1, len(net.languages))))
            _add_windows(net, tables, data, offsets, lettered, total)
            best = total.argmax(axis=1)
            size = np.maximum(np.diff(offsets), 1)
            names = [net.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), lettered.tolist(), strict=True)]
            score = np.where(lettered, np.minimum(total[np.arange(len(best)), best] / size, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    source = docs.select(*keep, has_letter(F.col(text_col)).alias("_lettered"), F.col(text_col).alias("_text"))
    return source.mapInArrow(scored, source.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


def _add_windows(net: ByteNetwork, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, lettered: np.ndarray, total: np.ndarray) -> None:
    """Add each window's probabilities, times its bytes, to its text's row of ``total``."""
    rows = np.flatnonzero(lettered)
    step = 1 << 21
    first = 0
    while first < len(rows):
        last = first + 1
        while last < len(rows) and offsets[rows[last] + 1] - offsets[rows[first]] <= step:
            last += 1
        own = rows[first:last]
        lengths = offsets[own + 1] - offsets[own]
        inside = np.repeat(offsets[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        windows, row, filled = in_windows(data[inside], np.r_[0, np.cumsum(lengths)])
        for a in range(0, len(windows), BATCH):
            pooled, _ = net.pooled(windows[a : a + BATCH], tables)
            np.add.at(total, own[row[a : a + BATCH]], net.softmax(pooled) * filled[a : a + BATCH, None])
        first = last
