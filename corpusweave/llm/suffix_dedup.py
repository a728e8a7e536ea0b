"""Removal of byte strings that occur more than once: anchors, suffix arrays per shard, cross-shard search.

A string of ``length`` bytes is decided by its suffix array, but the whole corpus need not be sorted.
Every string has one *anchor*: of the ``ANCHOR_BYTES`` long windows inside it, the first with the
smallest hash. Equal strings have equal anchors at the same distance. A *context* is a run of strings
with one anchor. Only contexts whose anchor hash occurs twice can repeat. If all contexts of an anchor
hash are equal, all their strings repeat; else equal contexts are counted and one of each is kept, with
its count as weight. These are laid out in shards, so that contexts with one anchor hash meet in a
shard, or in all pairs of shards if the hash is too frequent for one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import suffix_arrays
from corpusweave.llm.bytehash import mix, powers, prefix_sums, slices, sliding_min, span_hashes, split_words, text_bytes
from corpusweave.session import scratch_path, scratch_scope, set_down, ship_package

LENGTH = 400  # bytes
ANCHOR_BYTES = 200
PASSAGE_WORDS = 50  # words of a repeated passage where whole words are cut out
SHARD_BYTES = 1 << 20  # of contexts in one suffix array
SPLIT_CONTEXTS = 4_096  # contexts of one anchor hash beyond which they are split into several shards
MAX_BROADCAST_ROWS = 1_000_000  # of narrow rows
_WORD_BYTES = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SLICE = 1 << 21
_PLACE = np.uint64((1 << 32) - 1)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, key, digest, start, count) of each context: strings start .. start + count - 1 of a row."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    prints = mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    # the upper half of the hash, then the place: the first of equals wins
    chosen = sliding_min((prints & ~_PLACE) | np.arange(len(prints), dtype=np.uint64), length - anchor + 1)
    owner = (chosen & _PLACE).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[1:][row])
    own = owner[start]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else start
    count = np.diff(np.r_[first, len(start)])
    begin = start[first]
    digest = span_hashes(sums, begin, begin + count + length - 1)
    row = row[begin]
    return row, prints[own[first]].view(np.int64), digest.view(np.int64), begin - offsets[row], count


class Shard:
    """Contexts laid out as one text, overlapping neighbours of a document joined; its suffix array."""

    def __init__(self, docs: list, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray, bodies: list[bytes], length: int):
        self.length = length
        parts, places, at, doc, end = [], np.zeros(len(bodies), np.int64), 0, None, 0
        for i, body in enumerate(bodies):
            start = int(starts[i])
            if docs[i] == doc and start <= end:
                places[i] = at - (end - start)
                body = body[end - start :]
            else:
                parts.append(np.array([256]))
                at += 1
                places[i] = at
            parts.append(np.frombuffer(body, np.uint8))
            at += len(body)
            doc, end = docs[i], max(end if docs[i] == doc else 0, start + int(counts[i]) + length - 1)
        self.data = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.places, self.counts = places, counts
        self.weight = np.zeros(len(self.data), np.int64)  # at the first byte of each string
        for place, count, weight in zip(places, counts, weights, strict=True):
            self.weight[place : place + count] = weight
        self.order = suffix_arrays.suffix_array(self.data, length)

    def repeated(self) -> np.ndarray:
        """By position: strings that occur more than once, counted with their weights."""
        shared = suffix_arrays.common_prefixes(self.data, self.order, self.length)
        group = np.cumsum(shared < self.length) - 1
        total = np.bincount(group, self.weight[self.order], minlength=1)
        found = np.zeros(len(self.data), bool)
        found[self.order] = total[group] >= 2 if len(group) else False
        return found & (self.weight > 0)

    def found_in(self, other: Shard) -> np.ndarray:
        """By position: strings that are strings of the other shard."""
        places = other.order[other.weight[other.order] > 0]
        found, reach = np.zeros(len(self.data), bool), np.arange(self.length)
        own = np.flatnonzero(self.weight > 0)
        for first in range(0, len(own), 2_048):
            at = own[first : first + 2_048]
            found[at] = suffix_arrays.find(other.data, places, self.data[at[:, None] + reach])
        return found

    def runs(self, found: np.ndarray) -> list[list[int]]:
        """For each context: begins and ends (exclusive), in turn, of its runs of found strings."""
        result = []
        for place, count in zip(self.places.tolist(), self.counts.tolist(), strict=True):
            edge = np.diff(np.r_[False, found[place : place + count], False].astype(np.int8))
            result.append(np.flatnonzero(edge).tolist())
        return result


def _shard_runs(group: pa.Table, length: int) -> pa.Table:
    """Runs of repeated strings of the contexts in one shard, or between the two parts of a pair."""
    group = group.sort_by([("part", "ascending"), ("_id", "ascending"), ("_th", "ascending"), ("start", "ascending")])
    key, digest = group["key"].to_numpy(), group["digest"].to_numpy()
    _, once = np.unique(np.stack([key, digest]), axis=1, return_index=True)  # copies of a row bring copies
    group = group.take(pa.array(np.sort(once)))
    docs = list(zip(group["_id"].to_pylist(), group["_th"].to_pylist(), strict=True))
    part = group["part"].to_numpy()
    shards = []
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        sub = group.take(pa.array(at))
        shards.append(
            Shard([docs[i] for i in at], sub["start"].to_numpy(), sub["n"].to_numpy(), sub["weight"].to_numpy(), sub["body"].to_pylist(), length)
        )
    if group["low"][0].as_py() == group["high"][0].as_py():
        found = [shards[0].repeated()]
    elif len(shards) == 2:
        found = [shards[0].found_in(shards[1]), shards[1].found_in(shards[0])]
    else:
        found = [np.zeros(len(shards[0].data), bool)]
    runs = [r for shard, f in zip(shards, found, strict=True) for r in shard.runs(f)]
    table = pa.table({"kind": group["kind"], "key": group["key"], "digest": group["digest"], "runs": pa.array(runs, pa.list_(pa.int32()))})
    return table.filter(pa.array([len(r) > 0 for r in runs], pa.bool_()))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every document as (_id, _th, _text), _th a hash of the text, a null text empty."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A code of four bytes for each word of all texts, and where each text's words begin."""
    words, offsets = split_words(texts)
    found = pc.dictionary_encode(words)
    names = np.array([xxhash.xxh32_intdigest(w) for w in found.dictionary.to_pylist()], "<u4")
    return names[found.indices.to_numpy()] if len(words) else names, offsets


def coded_words(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`keyed_texts` with the texts as their words, each a code of four bytes: a string
    of 4 n bytes that begins at a word is then n words. Words are runs without ASCII space."""
    ship_package(rows.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = word_codes(batch.column(2))
            data, ends = codes.tobytes(), (offsets * _WORD_BYTES).tolist()
            parts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["_id", "_th", "_text"])

    return rows.mapInArrow(coded, f"_id {rows.schema['_id'].dataType.simpleString()}, _th long, _text binary")


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR_BYTES, shard_bytes: int = SHARD_BYTES, split_contexts: int = SPLIT_CONTEXTS, passage_words: int | None = None
) -> DataFrame:
    """(_id, _th, spans, passages) for ``rows`` (_id, _th, _text) that have repeats. ``spans`` is a list of
    (first, end) byte ranges, each a run of repeated strings.

    With ``passage_words`` the sequences of that many words are searched in the same jobs, in the texts
    written as four bytes a word; ``passages`` are their ranges in bytes of those texts. Rows with equal
    ids stay apart by _th, and rows equal in both share spans.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind_of_id = rows.schema["_id"].dataType.simpleString()
    # by kind: bytes of a unit, of a string, of an anchor
    kinds = [(1, length, anchor)]
    if passage_words:
        kinds.append((_WORD_BYTES, passage_words * _WORD_BYTES, max(1, passage_words // 2) * _WORD_BYTES))
    lengths = [string for _, string, _ in kinds]
    string_bytes = F.when(F.col("kind") == 0, lengths[0]).otherwise(lengths[-1])

    def layouts(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, a: int, b: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Units of the texts a to b of a batch, and where each text begins."""
        if kind:
            return word_codes(texts.slice(a, b - a))
        return data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, _SLICE):
                for kind, (unit, string, part) in enumerate(kinds):
                    body, begins = layouts(batch.column(2), data, offsets, a, b, kind)
                    row, key, digest, start, count = contexts(body, begins, string // unit, part // unit)
                    if len(row):
                        at = pa.array(row + a)
                        # strings that begin inside a unit are taken along
                        start, count = start * unit, (count - 1) * unit + 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), kind, np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(digest),
                             pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                            ["kind", "_id", "_th", "key", "digest", "start", "n"],
                        )

    def written(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
        path = path or scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.parquet(path)

    kept = scratch_path(spark, "repeats")
    with scratch_scope(spark):
        every = written(rows.mapInArrow(anchored, f"kind int, _id {kind_of_id}, _th long, key long, digest long, start int, n int"), "contexts")
        # a table of its own: joined with the contexts, a frequent key can then be split
        keys = written(
            every.groupBy("kind", "key")
            .agg(F.count("*").alias("m"), F.min("digest").alias("low"), F.max("digest").alias("high"))
            .where("m > 1")
            .select("kind", "key", (F.col("low") != F.col("high")).alias("mixed")),
            "keys",
        )
        repeats = written(every.join(keys, ["kind", "key"]), "repeats", kept)
    distinct = written(
        repeats.where("mixed")
        .groupBy("kind", "key", "digest")
        .agg(F.count("*").alias("weight"), F.min(F.struct("_id", "_th", "start", "n")).alias("first"))
        .select("kind", "key", "digest", "weight", "first.*"),
        "distinct",
    )
    sizes = {r["kind"]: r["size"] for r in distinct.groupBy("kind").agg(F.sum(F.col("n") + (string_bytes - 1)).alias("size")).collect()}  # two at most
    shards = [max(1, -(-sizes.get(kind, 0) // shard_bytes)) for kind in range(len(kinds))]
    large = written(distinct.groupBy("kind", "key").count().where(F.col("count") > split_contexts), "frequent")
    if large.count() <= MAX_BROADCAST_ROWS:  # at most one of ``split_contexts`` distinct contexts
        large = F.broadcast(large)
    parts = F.coalesce(F.ceil(F.col("count") / split_contexts), F.lit(1)).cast("int")
    home = F.pmod(F.xxhash64("key"), F.when(F.col("kind") == 0, shards[0]).otherwise(shards[-1]))
    laid = (
        distinct.join(large, ["kind", "key"], "left")
        .withColumns({"parts": parts, "shard": F.when(F.col("count").isNull(), home).otherwise(F.col("key")), "alone": F.col("count").isNotNull()})
        .withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    )
    columns = {"kind": "int", "key": "long", "digest": "long", "weight": "long", "start": "int", "n": "int", "alone": "boolean", "shard": "long", "part": "int", "parts": "int"}
    asked = laid.groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(F.collect_list(F.struct(*columns)).alias("asked"))

    def with_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, _SLICE):
                some = batch.column(3).slice(a, b - a)
                row, flat = pc.list_parent_indices(some).to_numpy(), some.flatten()
                kind, start, n = (flat.field(name).to_numpy() for name in ("kind", "start", "n"))
                for k in np.unique(kind).tolist():
                    at = np.flatnonzero(kind == k)
                    body, begins = layouts(batch.column(2), data, offsets, a, b, k)
                    body, first = body.tobytes(), begins[row[at]] * kinds[k][0] + start[at]
                    bodies = [body[x:y] for x, y in zip(first.tolist(), (first + n[at] + lengths[k] - 1).tolist(), strict=True)]
                    chosen, owner = flat.take(pa.array(at)), pa.array(row[at] + a)
                    yield pa.RecordBatch.from_arrays(
                        [*(chosen.field(name) for name in columns), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(bodies, pa.binary())],
                        [*columns, "_id", "_th", "body"],
                    )

    bodied = (
        rows.join(asked, rows._id.eqNullSafe(asked._i) & (rows._th == asked._t))
        .select("_id", "_th", "_text", "asked")
        .mapInArrow(with_bodies, ", ".join(f"{name} {kind}" for name, kind in columns.items()) + f", _id {kind_of_id}, _th long, body binary")
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .drop("parts", "other")
    )
    runs = bodied.groupBy("kind", "alone", "shard", "low", "high").applyInArrow(
        lambda group: _shard_runs(group, lengths[group["kind"][0].as_py()]), "kind int, key long, digest long, runs array<int>"
    )
    some = (
        repeats.where("mixed")
        .join(runs, ["kind", "key", "digest"])
        .select("kind", "_id", "_th", "start", F.explode(F.expr("transform(sequence(0, size(runs) - 1, 2), i -> struct(runs[i] as a, runs[i + 1] as b))")).alias("r"))
        .select("kind", "_id", "_th", "start", "r.a", "r.b")
    )
    found = repeats.where("not mixed").select("kind", "_id", "_th", "start", F.lit(0).alias("a"), F.col("n").alias("b")).union(some)
    span = F.struct((F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b") + (string_bytes - 1)).alias("end"))
    lists = [F.collect_set(F.when(F.col("kind") == kind, span)).alias(name) for kind, name in enumerate(("spans", "passages"))]
    return found.groupBy("_id", "_th").agg(*lists)


def cover(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges; ranges that touch are one run."""
    merged: list[list[int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([first, end])
    return [(a, b) for a, b in merged]


def whole_words(spans: list[dict]) -> list[dict]:
    """Byte ranges of :func:`coded_words` texts as ranges of words: a string may take in bytes of a
    neighbouring word that happen to be alike."""
    return [{"first": -(-s["first"] // _WORD_BYTES), "end": s["end"] // _WORD_BYTES} for s in spans]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False,
    shard_bytes: int = SHARD_BYTES, split_contexts: int = SPLIT_CONTEXTS, anchor: int = ANCHOR_BYTES, passage_words: int | None = None,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, ``kept`` (binary, the bytes left) and
    ``text`` (the same as a string, without characters that a cut splits).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the input, in the
    same document or another (the first occurrence goes as well). Strings never cross documents. Null
    and empty texts give 0 bytes; texts shorter than ``length`` are whole; repeated rows repeat each
    other's texts and so lose them; null ids are kept; other columns are not read. With ``digest`` the
    kept bytes are replaced in the task by kept_sha256.

    With ``passage_words`` a column n_passage_words says how many words of the input lie in passages of
    that many words or more that occur more than once (those that :func:`drop_repeats` takes out). They
    may be shorter than ``length`` bytes; they are counted, not removed.
    """
    rows = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(rows, length, anchor, shard_bytes, split_contexts, passage_words)
    spans = spans.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "spans", "passages")
    joined = rows.join(spans, rows._id.eqNullSafe(spans._i) & (rows._th == spans._t), "left").select(F.col("_id").alias(id_col), "_text", "spans", "passages")
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")
    extra = {"n_passage_words": "long"} if passage_words else {}

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found: list[list] = [[], [], [], [], [], []]
            for i, (spans, passages) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                body = data[offsets[i] : offsets[i + 1]].tobytes()
                runs = cover(spans.as_py() or [])
                n_words = sum(b - a for a, b in cover(whole_words(passages.as_py() or [])))
                edges = [0, *(x for run in runs for x in run), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(
                    found,
                    (len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept, kept.decode(errors="ignore"), n_words),
                    strict=True,
                ):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)][: 5 + len(extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_bytes", "n_removed", "n_spans", last, "text", *extra])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, {last} {kind}, text string"
    schema += "".join(f", {name} {type_}" for name, type_ in extra.items())
    return joined.mapInArrow(cleaned, schema)


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS, shard_bytes: int = SHARD_BYTES, split_contexts: int = SPLIT_CONTEXTS
) -> DataFrame:
    """``docs`` without the passages of ``words`` or more words that occur more than once; all rows and columns stay.

    A word goes if a sequence of ``words`` words over it also starts anywhere else in the input, in the
    same document or another, whatever white space parts the words; so do the spaces up to the next kept
    word. Both occurrences go, as judged on the input. The suffix arrays are those of the texts written
    as four bytes for each word. A null text stays null, an empty one empty; shorter texts are whole;
    repeated rows lose their texts to each other; columns of any name are kept.
    """
    # set down, so that words are coded once and by one Python worker at a time
    coded = set_down(coded_words(keyed_texts(docs, id_col, text_col)), "word-codes")
    spans = repeated_spans(coded, words * _WORD_BYTES, words * _WORD_BYTES // 2, shard_bytes, split_contexts)
    spans = spans.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "spans")
    own = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_th"), F.col(text_col).alias("_text")
    )
    joined = own.join(spans, own._id.eqNullSafe(spans._i) & (own._th == spans._t), "left").select("_row", "_text", "spans")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, found in enumerate(batch.column(2).to_pylist()):
                if found:
                    body = texts[i].encode()
                    starts = [m.start() for m in _WORD.finditer(body)] + [len(body)]
                    edges = [0, *(starts[x] for run in cover(whole_words(found)) for x in run), len(body)]
                    texts[i] = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    done = joined.mapInArrow(cleaned, joined.drop("spans").schema)
    return done.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
