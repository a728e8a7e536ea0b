"""SimHash near-duplicates: fingerprints, BK-trees per shard, and components of the links."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.bytehash import text_bytes
from corpusweave.session import cut_lineage, scratch_path, ship_package

SHINGLE = 4  # words
RADIUS = 4  # differing bits that still link
SHARD_ROWS = 16_384  # fingerprints in one tree; fuller buckets are split and their parts paired


def fingerprint(words: list[bytes], width: int) -> int:
    """Majority bits over the XXH64 (seed 42) of all word shingles, as an unsigned 64-bit integer."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [joined]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes).tolist(), ends[width - 1 :].tolist()
        spans = [joined[a:b] for a, b in zip(first, last, strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in spans], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and ``fp`` (long, the fingerprint's 64 bits) of every row; moves nothing."""
    ship_package(docs.sparkSession)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            offsets = offsets.tolist()
            found = [
                fingerprint(data[a:b].tobytes().lower().split(), shingle)  # bytes: only A-Z and ASCII spaces
                for a, b in zip(offsets, offsets[1:], strict=False)
            ]
            column = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*keep, "fp"])

    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = source.select(*keep).schema.add("fp", "long")
    return source.mapInArrow(printed, schema)


class Forest:
    """BK-trees over several buckets at once, held in flat arrays.

    A node's children are keyed by their Hamming distance to it. All rows of a bucket start at its
    root (its first row); each round the first row at every distance becomes that child and the others
    descend to it, until every row is a node.
    """

    def __init__(self, prints: np.ndarray, buckets: np.ndarray):
        self.prints = prints
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        self.root = np.repeat(starts, np.diff(np.r_[starts, len(prints)]))
        rows = np.setdiff1d(np.arange(len(prints)), starts, assume_unique=True)
        at, edges = self.root[rows], []
        while len(rows):
            key = at * 65 + np.bitwise_count(prints[rows] ^ prints[at])
            unique, first, place = np.unique(key, return_index=True, return_inverse=True)
            child = rows[first]
            edges.append((unique, child))
            rest = child[place] != rows
            rows, at = rows[rest], child[place][rest]
        key = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        child = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]  # (parent, distance) -> child

    def links(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query row, earlier row) within the radius, following only edges that can hold one."""
        row, node, found = queries, self.root[queries], []
        while len(row):
            distance = np.bitwise_count(self.prints[row] ^ self.prints[node]).astype(np.int64)
            near = (distance <= radius) & (node < row)
            found.append((row[near], node[near]))
            low = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, node = np.repeat(row, count), self.child[np.repeat(low, count) + step]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_links(prints: np.ndarray, buckets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) pairs that join the same rows as all links within the buckets do."""
    forest, label = Forest(prints, buckets), np.arange(len(prints))
    for first in range(0, len(prints), 1_024):
        a, b = forest.links(np.arange(first, min(first + 1_024, len(prints))), radius)
        while len(a):
            roots = np.stack([np.maximum(label[a], label[b]), np.minimum(label[a], label[b])])
            apart = roots[0] != roots[1]
            a, b, roots = a[apart], b[apart], roots[:, apart]
            np.minimum.at(label, roots[0], roots[1])
            while not np.array_equal(label, jumped := label[label]):
                label = jumped
    rows = np.flatnonzero(label != np.arange(len(prints)))
    return rows, label[rows]


def _table_keys(radius: int) -> list[Column]:
    """Two of radius + 2 bit blocks agree in any linked pair: one key for each pair of blocks."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    block = [
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)
    ]
    pairs = itertools.combinations(range(radius + 2), 2)
    return [
        F.lit(t << 48) + F.shiftleft(block[i], 24) + block[j] for t, (i, j) in enumerate(pairs)
    ]


def near_edges(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all pairs within the radius.

    Fingerprints are shuffled to the buckets of all block pairs, so that linked ones meet in at least
    one. A bucket of more than ``shard_rows`` is split by hash and every two parts are compared, so no
    task holds more than two parts and no link is lost. Each bucket gives a spanning set of its links.
    """
    spark = prints.sparkSession
    ship_package(spark)
    rows = prints.select("fp", F.explode(F.array(*_table_keys(radius))).alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1")
    parts = F.ceil(F.col("count") / shard_rows).cast("int")
    grouped = (
        rows.join(sizes, "key")
        .withColumns({"parts": parts, "part": F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int")})
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("fp", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )
    shards = grouped.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)

        def pairs(block: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.r_[False, (block[1:, 1:] != block[1:, :-1]).any(axis=0)])
            a, b = spanning_links(block[0].view(np.uint64), bucket, radius)
            return pa.RecordBatch.from_arrays([pa.array(block[0][a]), pa.array(block[0][b])], ["a", "b"])

        for batch in batches:
            block = np.concatenate([held, [c.to_numpy().astype(np.int64) for c in batch.columns]], axis=1)
            if block.shape[1] == 0:
                continue
            last = np.flatnonzero((block[1:, :] != block[1:, -1:]).any(axis=0))
            done = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if done:
                yield pairs(np.ascontiguousarray(block[:, :done]))
            held = block[:, done:]
        if held.shape[1]:
            yield pairs(np.ascontiguousarray(held))

    return shards.mapInArrow(linked, "a long, b long").distinct()


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node that has one.

    Large-star and small-star rounds; each is written to the checkpoint folder. Hubs are only ever
    reduced by a minimum or split by the join, never gathered. Raises if ``most`` rounds do not do.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b"))
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are set down, so that the join with them can split a hub
        least = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = cut_lineage(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(low, "a")
        edges = cut_lineage(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def own_tie(text_col: str) -> Column:
    """The text's hash: (id, tie) names a row, apart from exact copies of it."""
    return F.xxhash64(text_col)


def first_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """(fp, first): the smallest (id, tie) of each fingerprint, nulls last."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_tie").alias("t")))
    return rows.groupBy("fp").agg(first.alias("first"))


def standing_rows(rows: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Id, ``_tie``, fp, component_id and ``_first`` of every row, from the components of its fingerprints."""
    known = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # set down, so that the join with it can split the root of a large group
    least = cut_lineage(known.groupBy("root").agg(F.min("first").alias("least")))
    named = known.join(least, "root").select("fp", "least")
    return rows.join(named, "fp").select(
        id_col,
        "_tie",
        "fp",
        F.col("least.i").alias("component_id"),
        (F.col(id_col).eqNullSafe(F.col("least.i")) & (F.col("_tie") == F.col("least.t"))).alias("_first"),
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per document: id, ``_tie``, fingerprint (16 hex digits), component_id, ``_first``.

    Words are lower-cased (A-Z) runs of non-space; a text with fewer than ``shingle`` words is one
    shingle; null and empty texts have fingerprint zero. Fingerprints link at ``radius`` or fewer
    differing bits, and component_id is the smallest id reachable over links (null if all ids of the
    component are null). ``_tie`` is the text's hash; ``_first`` marks the
    rows that stand for their component: its smallest (id, tie), nulls last. Copies share a fingerprint
    and are grouped before any comparison; the empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    keyed = docs.select(id_col, own_tie(text_col).alias("_tie"), F.col(text_col).alias("_body"))
    add_fingerprints(keyed, [id_col, "_tie"], "_body", shingle).write.parquet(path)
    rows = spark.read.parquet(path)
    prints = first_rows(rows, id_col)
    roots = components(near_edges(prints.select("fp"), radius))
    printed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return standing_rows(rows, prints, roots, id_col).select(id_col, "_tie", printed, "component_id", "_first")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, tie) that is ``_first`` in ``groups``, with all its columns."""
    kept = groups.where("_first").select(F.col(id_col).alias("_id"), "_tie").distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(id_col).alias("_own_id"),
        own_tie(text_col).alias("_own_tie"),
    )
    joined = rows.join(kept, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_tie") == F.col("_tie")))
    order = Window.partitionBy("_id", "_tie").orderBy("_tie")
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row.*")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each, with all their columns.

    Among rows with the same id and text one stays.
    """
    return one_of_each(docs, simhash_groups(docs, id_col, text_col, shingle, radius), id_col, text_col)
