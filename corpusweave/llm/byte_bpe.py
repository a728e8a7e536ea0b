"""Byte-level BPE by ranks: long texts are pre-tokenised as overlapping chunks and stitched."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import bytepairs
from corpusweave.session import ship_package

CHUNK = 16_384  # code points that a chunk advances
OVERLAP = 1_024  # code points that it shares with the next one
_KEY = ["_doc", "_hash", "_length"]


def boundaries(chunk: str, last: bool) -> np.ndarray:
    """Starts and ends of the pre-token units of a chunk that more text could not change."""
    ends = np.fromiter((m.end() for m in bytepairs.UNIT.finditer(chunk)), np.int64)
    if not last:  # deciding a unit takes up to two characters behind it
        ends = ends[ends + 2 <= len(chunk)]
    return np.concatenate([[0], ends]).astype(np.int64)


def stitch(chunks: list[str], bounds: list[np.ndarray], advance: int) -> tuple[str, np.ndarray]:
    """The whole text and the unit boundaries that a single pass over it would find.

    ``bounds[i]`` holds ``boundaries(chunks[i])``; chunk i starts at ``i * advance``. Where both
    neighbours see the same boundary they agree from there on. Without one in the overlap (a run longer
    than it), the text is read on from the last sure boundary.
    """
    text, sure = chunks[0], bounds[0]
    for i in range(1, len(chunks)):
        start = i * advance
        text = text[:start] + chunks[i]
        found = bounds[i] + start
        common = np.intersect1d(sure[sure >= start], found)
        if len(common):
            at = common[0]
            sure = np.concatenate([sure[sure <= at], found[found > at]])
        else:
            more = boundaries(text[sure[-1] :], i == len(chunks) - 1) + sure[-1]
            sure = np.concatenate([sure, more[1:]])
    return text, sure


def _coded(coder: bytepairs.RankEncoder, units: list[str]) -> tuple[int, bytes, bytes]:
    """Number of ids, the ids as little-endian 32-bit integers, and the bytes they decode to."""
    ids = b"".join(map(coder.__getitem__, units))
    numbers = np.frombuffer(ids, "<u4")
    return len(numbers), ids, coder.decode(numbers.tolist())


def encode_bytes(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    With ``digest`` the two binaries are replaced in the task by their SHA-256 (ids_sha256,
    decoded_sha256), so that they are never moved. A text of one chunk is encoded where it is read.
    The chunks of longer texts are spread over all tasks, pre-tokenised there, brought together by
    document, stitched and encoded; a group is one document, as large as its row was. A null text
    counts as empty (no ids). Rows with equal id and text give equal rows, as many as there were; null
    ids are kept; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(ranks_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    types = ["long", "string", "string"] if digest else ["long", "binary", "binary"]
    fields = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    arrow = [pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.binary()]

    def row(coder: bytepairs.RankEncoder, units: list[str]) -> tuple:
        count, ids, raw = _coded(coder, units)
        return (count, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (count, ids, raw)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytepairs.once(bytepairs.RankEncoder, content)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                found = [row(coder, bytepairs.UNIT.findall(t.as_py())) for t in part.column(1)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("chunk").to_pylist()
            last = batch.column("last").to_pylist()
            bounds = [boundaries(t, x).tobytes() for t, x in zip(texts, last, strict=True)]
            yield batch.append_column("bounds", pa.array(bounds, pa.binary()))

    def joined(group: pa.Table) -> pa.Table:
        coder = bytepairs.once(bytepairs.RankEncoder, content)
        group = group.sort_by("place")
        places = group["place"].to_numpy()
        copies = int((places == 0).sum())  # rows with equal id and text
        texts, bounds = group["chunk"].to_pylist()[::copies], group["bounds"].to_pylist()[::copies]
        text, sure = stitch(texts, [np.frombuffer(b, np.int64) for b in bounds], chunk)
        sure = sure.tolist()
        found = row(coder, [text[a:b] for a, b in zip(sure, sure[1:], strict=False)])
        ids = group["_doc"].slice(0, 1).to_pylist() * copies
        columns = [pa.array([x] * copies, t) for x, t in zip(found, arrow, strict=True)]
        return pa.Table.from_arrays([pa.array(ids, group["_doc"].type), *columns], names=[id_col, *names])

    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(text_col, F.lit("")).alias("_text"))
    length = F.length("_text")
    whole = rows.where(length <= chunk).select("_doc", "_text").mapInArrow(short, f"{id_col} {kind}, {fields}")
    places = F.sequence(F.lit(0), F.floor((length - 1) / chunk).cast("int"))
    chunks = (
        rows.where(length > chunk)
        .withColumns({"_hash": F.xxhash64("_text"), "_length": length})
        .withColumn("place", F.explode(places))
        .select(
            *_KEY,
            "place",
            F.expr(f"substring(_text, place * {chunk} + 1, {chunk + overlap})").alias("chunk"),
            (F.col("place") == F.floor((F.col("_length") - 1) / chunk)).alias("last"),
        )
        .repartition(*_KEY, "place")
    )
    cut_schema = chunks.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", bounds binary"
    long = chunks.mapInArrow(cut, cut_schema).groupBy(*_KEY).applyInArrow(joined, f"{id_col} {kind}, {fields}")
    return whole.unionByName(long)


def decode_bytes(coded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded`` (binary) of each row's ids; null ids give empty bytes. Moves nothing."""
    spark = coded.sparkSession
    ship_package(spark)
    with open(ranks_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytepairs.once(bytepairs.RankEncoder, content)
        for batch in batches:
            raw = [coder.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(decoded, f"{id_col} {kind}, decoded binary")
