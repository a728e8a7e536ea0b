"""Token ids as files: frequency ranks in byte-aligned codes of one to four bytes, control bytes apart.

Layout below a folder, both written and committed by Spark:

``vocabulary``  one row per used id: id, rank (0 is the most frequent), count
``blocks``      one row per block of whole documents in ascending order of their ids: shard, block,
                first (ids of the shard before it), tokens (its ids), doc_ids, sizes (ids of each document, little-endian
                unsigned 32-bit), control (two bits for each value, four values a byte, lowest first:
                its length less one), data (the values' bytes, little-endian)
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusweave.llm import bytepairs
from corpusweave.llm.bytehash import text_bytes
from corpusweave.session import scratch_path, ship_package

BLOCK_TOKENS = 1 << 19  # a block is closed when it holds this many
END_ID = 0
CACHED_UNITS = 1_500_000  # a worker empties its dictionary of encoded units when it holds this many
JOINT_UNITS = 128  # units that go to the library in one string
# number of bytes of each of the four values that a control byte stands for
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF) + (values > 0xFFFF).astype(np.int64) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(size)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        longer = size > k
        data[(ends - size)[longer] + k] = values[longer] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: a table lookup gives all lengths, a running sum their places."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(size, dtype=np.int64)
    starts, raw = ends - size, np.frombuffer(data, np.uint8)
    values = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        values[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


class UnitIds(dict):
    """unit -> ids (little-endian, ``kind``) by the tokenizers library; new units are encoded together."""

    def __init__(self, content: str):
        super().__init__()
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        # In a byte-level vocabulary a token has a character for each byte.
        vocab = self.library.get_vocab()
        self.sizes = np.zeros(1 + max(vocab.values(), default=0), np.int64)
        self.sizes[list(vocab.values())] = [len(token) for token in vocab]

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        code = "H" if self.kind == "<u2" else "I"
        return [array(code, x.ids).tobytes() for x in found]

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit. Units of a space and a word are encoded many in one string, whose pre-tokens
        begin anew at every space; the bytes that the ids stand for say where a unit ends. Where they
        do not meet the ends of the units, and for other units, each is encoded by itself."""
        found: dict[str, bytes] = {}
        joint = [u for u in units if len(u) > 1 and u[0] == " " and not u[1].isspace()]
        groups = [joint[i : i + JOINT_UNITS] for i in range(0, len(joint), JOINT_UNITS)]
        width = int(self.kind[-1])
        for group, coded in zip(groups, self.encode(["".join(g) for g in groups]), strict=True):
            reached = np.cumsum(self.sizes[np.frombuffer(coded, self.kind)])
            ends = np.cumsum([len(u.encode()) for u in group])
            place = np.searchsorted(reached, ends)
            if len(reached) and place[-1] == len(reached) - 1 and (reached[place] == ends).all():
                cuts = [0, *(width * (place + 1)).tolist()]
                found.update((u, coded[a:b]) for u, a, b in zip(group, cuts, cuts[1:], strict=False))
        rest = [u for u in units if u not in found]
        found.update(zip(rest, self.encode(rest), strict=True))
        return found

    def texts(self, texts: list[str]) -> list[bytes]:
        """One look-up for each unit; the units not seen before are encoded once for all texts. A text
        with a special string in it goes to the library as a whole."""
        if len(self) >= CACHED_UNITS:
            self.clear()
        rows: list[list] = []
        gaps: list[tuple[list, int, str]] = []
        for text in texts:
            if any(s in text for s in self.special):
                rows.append(self.encode([text]))
                continue
            units = bytepairs.UNIT.findall(text)
            parts = list(map(self.get, units))
            if None in parts:
                gaps += [(parts, i, units[i]) for i, p in enumerate(parts) if p is None]
            rows.append(parts)
        fresh = list({unit for _, _, unit in gaps})
        found = self.encode_units(fresh)
        for parts, i, unit in gaps:
            parts[i] = found[unit]
        for unit in [u for u in fresh if len(u) > 64]:  # not kept
            del found[unit]
        self.update(found)
        return [b"".join(parts) for parts in rows]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every text with the tokenizers library, close it with ``end_id``, and write the files.

    Texts are encoded where they are read and set down once; counts of ids (bounded by the vocabulary)
    give the ranks; documents are then range-partitioned by id, nulls first, rows of one id in the order
    in which they were set down, so that a frequent id is spread too. A null text is empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytepairs.once(UnitIds, content)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                end = np.array([end_id], coder.kind).tobytes()
                ids = [x + end for x in coder.texts(part.column(1).fill_null("").to_pylist())]
                width = pa.array([int(coder.kind[-1])] * len(ids), pa.int8())
                yield pa.RecordBatch.from_arrays([part.column(0), width, pa.array(ids, pa.binary())], ["id", "width", "ids"])

    raw = scratch_path(spark, "token-ids")
    rows = docs.select(id_col, text_col).mapInArrow(encoded, f"id {kind}, width tinyint, ids binary")
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.parquet(raw)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            width, (data, offsets) = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            for w in np.unique(width).tolist():  # one width for a vocabulary
                whole = data if (width == w).all() else np.concatenate([data[a:b] for a, b, own in zip(offsets, offsets[1:], width, strict=False) if own == w])
                own = np.bincount(whole.view(f"<u{w}"), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    counts = rows.select("width", "ids").mapInArrow(counted, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "id")) - 1)
    ranked.select("id", "rank", "count").write.parquet(f"{path}/vocabulary")
    _, by_id = _vocabulary(spark, path)
    ranks = spark.sparkContext.broadcast(by_id)
    schema = f"shard int, block int, first long, tokens long, doc_ids array<{kind}>, sizes binary, control binary, data binary"

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size, id_type = 0, None

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for _, x in held], "<u4")
            control, data = pack_values(ranks.value[np.concatenate([x for _, x in held])])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([int(sizes.sum(dtype=np.int64))], pa.int64()),
                    pa.array([[d for d, _ in held]], pa.list_(id_type)), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ],
                ["shard", "block", "first", "tokens", "doc_ids", "sizes", "control", "data"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for doc, width, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                held.append((doc, np.frombuffer(ids.as_py(), f"<u{width.as_py()}")))
                size += len(held[-1][1])
                if size >= block_tokens:
                    yield close()
                    held, block, first, size = [], block + 1, first + size, 0
        if held:
            yield close()

    ordered = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "width", "ids")
    ordered.mapInArrow(blocked, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _vocabulary(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(id by rank, rank by id); as long as the vocabulary."""
    table = spark.read.parquet(f"{path}/vocabulary").select("id", "rank").toArrow()
    ids, ranks = table["id"].to_numpy(), table["rank"].to_numpy()
    by_rank, by_id = np.zeros(len(ids), np.uint32), np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    by_rank[ranks], by_id[ids] = ids, ranks
    return by_rank, by_id


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids
    (binary, little-endian unsigned 32-bit, with the end id). Blocks are decoded where they are read;
    only one number per shard is brought together to place the shards."""
    ship_package(spark)
    by_rank, _ = _vocabulary(spark, path)
    names = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = blocks.join(offsets, "shard").select((F.col("offset") + F.col("first")).alias("first"), "doc_ids", "sizes", "control", "data")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, sizes, control, data in zip(*batch.columns, strict=True):
                size = np.frombuffer(sizes.as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(size)
                values = unpack_values(control.as_py(), data.as_py(), int(ends[-1]))
                ids = names.value[values].astype("<u4").tobytes()
                parts = [ids[4 * a : 4 * b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(first.as_py() + ends - size), pa.array(size), pa.array(parts, pa.binary())],
                    [id_col, "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decoded, f"{id_col} {kind}, start long, n_tokens long, ids binary")
