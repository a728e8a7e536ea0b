"""Token counts without identifiers: byte pairs are merged from a heap over a linked list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from corpusweave.llm import bytepairs
from corpusweave.session import ship_package

TOKEN_LIMIT = 512


class UnitCounts(dict):
    """unit -> number of tokens. Pre-tokens come from the library's own splitter, so that new code
    points fall in the same class; they are then merged and counted here."""

    def __init__(self, content: str):
        super().__init__()
        self.rules = bytepairs.JsonMerges(content)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.bytes = {symbol: b for b, symbol in bytepairs.byte_symbols().items()}
        self.pieces: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        if len(self) >= bytepairs.CACHED_UNITS:
            self.clear()
        if len(self.pieces) >= bytepairs.CACHED_PIECES:
            self.pieces.clear()
        total = 0
        for piece, _ in self.splitter.pre_tokenize_str(unit):
            count = self.pieces.get(piece)
            if count is None:
                count = self.rules.count(bytes(self.bytes[c] for c in piece))
                if len(piece) <= 64:
                    self.pieces[piece] = count
            total += count
        if len(unit) <= 64:
            self[unit] = total
        return total

    def text(self, text: str) -> int:
        """Special strings count as one token each and part the text."""
        parts, total = [text], 0
        for special in self.rules.special:
            cut = [part.split(special) for part in parts]
            total += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return total + sum(sum(map(self.__getitem__, bytepairs.UNIT.findall(p))) for p in parts)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts equal the length of the library's encoding without added special tokens. A null or empty
    text has 0 bytes and 0 tokens; null and repeated ids are kept row by row; other columns are not
    read; an empty table gives no rows. Nothing is shuffled, and a worker holds one batch of texts and
    a bounded dictionary. The vocabulary file is read by the driver and broadcast (its size is fixed).
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bytepairs.once(UnitCounts, content)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.cast(pc.binary_length(texts), pa.int64()),
                    pa.array([counts.text(t.as_py()) for t in texts], pa.int64()),
                ],
                [id_col, "n_bytes", "n_tokens"],
            )

    rows = docs.select(id_col, text_col).mapInArrow(counted, schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
