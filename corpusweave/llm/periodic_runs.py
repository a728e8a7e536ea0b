"""Runs of repeated word sequences: string synchronising sets at dyadic scales.

A run is a maximal stretch of words with smallest period q and at least four periods. At scale t, with
2t <= q < 4t, positions are picked by hashes alone: i is picked if, among the windows of t words that
start in i .. i + t, the one with the smallest hash starts at i or at i + t. Windows that lie in a run of
a period of at most t / 4 are left out of the choice, so that long repetitions of little do not fill the
set; those runs are known by then, as scales ascend and period 1 is found by comparing neighbours.

Equal contexts of 2t words are picked alike. In a run of at least 4q words some position of its first
period is picked (else that period and 2t words more would repeat with a period of t / 4, and so would the
whole run), and its context of 4t words comes again exactly q words on. So consecutive picked positions
with equal contexts of 4t words propose all periods of the scale; binary search over hashes of prefixes
extends each proposal to its run. Words and contexts are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.bytehash import mix, powers, slices, sliding_min, span_hashes, split_words
from corpusweave.session import ship_package

LEAST_WORDS = 6  # length of a reported run
PERIODS = 4  # and how often its period fits at least; the proof above needs four
_SLICE = 1 << 21  # bytes of text that are searched at a time
_NONE = np.iinfo(np.uint64).max


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, an equal number for equal words, and where each text's begin."""
    words, offsets = split_words(texts)
    return words, pc.dictionary_encode(words).indices.to_numpy().astype(np.int64), offsets


def _laid_out(codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the chosen documents, each followed by a word of its own, and where each begins."""
    sizes = (offsets[1:] - offsets[:-1])[docs]
    begin = np.r_[0, np.cumsum(sizes + 1)]
    out = np.empty(begin[-1], np.int64)
    out[begin[1:] - 1] = -1 - np.arange(len(docs))
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    first = offsets[docs]
    out[inside] = codes[np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
    return out, begin[:-1]


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are hashes of spans of values."""
    up, _ = powers(len(values) + 1)
    return np.r_[np.uint64(0), np.cumsum(mix(values.view(np.uint64) + np.uint64(1)) * up[:-1])]


def _reach(sums: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many values from ``a`` and ``b`` on (or before them) agree, between ``least`` and ``most``."""
    low, high = least.copy(), most.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        if back:
            same = span_hashes(sums, a - half, a) == span_hashes(sums, b - half, b)
        else:
            same = span_hashes(sums, a, a + half) == span_hashes(sums, b, b + half)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def synchronising_set(sums: np.ndarray, width: int, periodic: np.ndarray) -> np.ndarray:
    """Picked positions at scale ``width``; ``periodic`` marks window starts that are left out."""
    windows = len(sums) - width  # starts 0 .. windows - 1
    if windows <= width:
        return np.zeros(0, np.int64)
    _, down = powers(len(sums))
    prints = mix((sums[width:] - sums[:-width]) * down[:windows])
    prints[periodic[:windows]] = _NONE
    least = sliding_min(prints, width + 1)
    ends = (prints[: len(least)] == least) | (prints[width:] == least)
    return np.flatnonzero(ends & (least != _NONE))


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, ordered by document, start and period."""
    lengths = np.diff(offsets)
    found = [_equal_neighbours(codes, offsets)]
    width = 1
    while len(docs := np.flatnonzero(lengths >= 2 * PERIODS * width)):
        text, begin = _laid_out(codes, offsets, docs)
        sums = _sums(text)
        place = np.full(len(lengths), -1)
        place[docs] = np.arange(len(docs))
        known = np.concatenate(found)
        known = known[(place[known[:, 0]] >= 0) & (known[:, 3] * PERIODS <= width) & (known[:, 2] >= width)]
        edge = np.zeros(len(text) + 1, np.int64)
        at = begin[place[known[:, 0]]] + known[:, 1]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + known[:, 2] - width + 1, -1)
        picked = synchronising_set(sums, width, np.cumsum(edge[:-1]) > 0)
        picked = picked[picked + 4 * width <= len(text)]
        context = span_hashes(sums, picked, picked + 4 * width)
        order = np.argsort(context, kind="stable")
        same = context[order[1:]] == context[order[:-1]]
        a, b = picked[order[:-1][same]], picked[order[1:][same]]
        near = (b - a >= 2 * width) & (b - a < 4 * width)
        a, b = a[near], b[near]
        if len(a):
            doc = np.searchsorted(begin, a, "right") - 1
            first, last = begin[doc], begin[doc] + lengths[docs[doc]]
            start = a - _reach(sums, a, b, np.zeros_like(a), a - first, back=True)
            end = b + _reach(sums, a, b, np.full_like(a, 4 * width), last - b, back=False)
            rows = np.stack([docs[doc], start - first, end - start, b - a], axis=1)
            found.append(np.unique(rows[rows[:, 2] >= PERIODS * rows[:, 3]], axis=0))
        width *= 2
    rows = np.concatenate(found)
    rows = rows[rows[:, 2] >= least]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _equal_neighbours(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of period 1: the same word at least four times in a row."""
    if len(codes) == 0:
        return np.zeros((0, 4), np.int64)
    fresh = np.r_[True, codes[1:] != codes[:-1]]
    fresh[offsets[:-1][offsets[:-1] < len(codes)]] = True
    start = np.flatnonzero(fresh)
    size = np.diff(np.r_[start, len(codes)])
    long = size >= PERIODS
    start, size = start[long], size[long]
    doc = np.searchsorted(offsets, start, "right") - 1
    return np.stack([doc, start - offsets[doc], size, np.ones_like(size)], axis=1)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: id, n_runs, start, length, period and exponent_milli of its longest run
    (ties: smallest start, then period; nulls without a run), ``runs``, a list of (start, length, period)
    by start and period, and ``collapsed``, the words that no run repeats, joined by one space.

    A run has the smallest period q, at least ``LEAST_WORDS`` words and four periods, and cannot be
    extended; all but its first q words are dropped from ``collapsed``. With ``digest`` the last two
    become runs_sha256 (of "start,length,period" lines) and collapsed_sha256 in the task.

    Words are runs without ASCII space; a null or empty text has none. Whole texts are searched, a few
    megabytes of them or one long text at a time. Null and repeated ids are kept row by row, other columns
    are not read, nothing is shuffled; the empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    last = ["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]
    types = [pa.string(), pa.string()] if digest else [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
    names = ["n_runs", "start", "length", "period", "exponent_milli", *last]

    def described(words: pa.Array, rows: list[list[int]]) -> tuple:
        kept = words
        if rows:
            edge = np.zeros(len(words) + 1, np.int64)
            for start, length, period in rows:
                edge[start + period] += 1
                edge[start + length] -= 1
            kept = words.filter(pa.array(np.cumsum(edge[:-1]) == 0))
            start, length, period = min(rows, key=lambda r: (-r[1], r[0], r[2]))
            best = (start, length, period, 1000 * length // period)
        else:
            best = (None,) * 4
        text = " ".join(kept.to_pylist())
        if digest:
            lines = "".join(f"{a},{n},{q}\n" for a, n, q in rows)
            return (len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        return (len(rows), *best, [{"start": a, "length": n, "period": q} for a, n, q in rows], text)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts.fill_null("")).to_numpy()
            for a, b in slices(np.r_[0, np.cumsum(sizes, dtype=np.int64)], _SLICE):
                words, codes, offsets = word_codes(texts.slice(a, b - a))
                runs = find_runs(codes, offsets)
                cuts = np.searchsorted(runs[:, 0], np.arange(b - a + 1))
                rows = [
                    described(words.slice(offsets[i], offsets[i + 1] - offsets[i]), runs[cuts[i] : cuts[i + 1], 1:].tolist()) for i in range(b - a)
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], [id_col, *names])

    ends = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    schema = f"{id_col} {kind}, n_runs long, start long, length long, period long, exponent_milli long, {ends}"
    return docs.select(id_col, F.col(text_col)).mapInArrow(searched, schema)
