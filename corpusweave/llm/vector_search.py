"""Exact top-k by inner product: branch and bound over vertical blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.session import ship_package

TOP = 10
SCALE = 1024
ROWS = 16_384  # vectors in one packed block
QUERIES = 1_024  # queries in one packed block
STEP = 8  # dimensions accumulated between two prunings


def best(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, step: int, top: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of at least the ``top`` best columns, ties included.

    ``columns`` is dimensions x rows; ``rest[b]`` holds the rows' norms over the dimensions from block
    b on. What a candidate can still gain or lose is bounded by the product of the remaining norms
    (Cauchy-Schwarz); a candidate goes once its best outcome is below the ``top``-th worst outcome.
    """
    size = len(query)
    mass = np.sqrt(np.r_[np.cumsum((query[::-1].astype(float)) ** 2)[::-1], 0.0])
    alive = np.flatnonzero(~skip)
    score = np.zeros(len(alive), np.int64)
    for block, first in enumerate(range(0, size, step)):
        part = columns[first : first + step]
        part = part if len(alive) == columns.shape[1] else part[:, alive]
        score += query[first : first + step] @ part
        if first + step >= size or len(alive) <= top:
            continue
        slack = mass[first + step] * rest[block + 1, alive] * (1 + 1e-9) + 1
        low = score - slack
        floor = np.partition(low, len(low) - top)[len(low) - top]
        keep = score + slack >= floor
        alive, score = alive[keep], score[keep]
    if len(score) > top:
        keep = score >= np.partition(score, len(score) - top)[len(score) - top]
        alive, score = alive[keep], score[keep]
    return alive, score


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def exact_top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP,
    scale: int = SCALE, rows: int = ROWS, queries: int = QUERIES, step: int = STEP,
) -> DataFrame:
    """(query_id, rank, <id>, score): the ``top`` highest inner products of floor(scale * x) per query.

    Candidates are all vectors with another id; ties go to the smaller id; a query with fewer than
    ``top`` candidates has all of them. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part. Shorter vectors are padded with zeros. Repeated ids are
    candidates each, and queries of one id count once. Scores are exact while they fit 63 bits.

    Vectors are packed by hash into blocks of about ``rows`` in vertical layout, queries into blocks of
    about ``queries``. Every pair of blocks is one search that returns its best ``top`` per query, so
    a task holds two blocks, and only those lists are shuffled.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    used = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
    whole = used.select(F.col(id_col).alias("id"), _whole(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    count = used.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size(vector_col)).alias("d")).first()
    width = count["d"] or 1
    row_blocks, query_blocks = max(1, -(-count["n"] // rows)), max(1, -(-(count["q"] or 0) // queries))

    def pack(group: pa.Table) -> pa.Table:
        lists = group["v"].combine_chunks()
        matrix = np.zeros((width, len(group)), np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(group)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        matrix[at, row] = lists.flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "block": group["block"].slice(0, 1),
            "ids": pa.array([group["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "matrix": pa.array([matrix.astype("<i8").tobytes()], pa.binary()),
        })

    def packed(frame: DataFrame, blocks: int) -> DataFrame:
        placed = frame.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
        return placed.groupBy("block").applyInArrow(pack, "block int, ids binary, matrix binary")

    data = packed(whole.select("id", "v"), row_blocks)
    asked = packed(whole.where("q").dropDuplicates(["id"]).select("id", "v"), query_blocks)
    pairs = (
        data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .join(asked.select(F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), "qb")
        .repartition("block", "qb")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix, q_ids, q_matrix in zip(*(batch.column(c) for c in ("ids", "matrix", "q_ids", "q_matrix")), strict=True):
                ids, q_ids = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(q_ids.as_py(), "<i8")
                columns = np.frombuffer(matrix.as_py(), "<i8").reshape(width, -1)
                asked_for = np.frombuffer(q_matrix.as_py(), "<i8").reshape(width, -1)
                squares = np.add.reduceat(columns.astype(float) ** 2, np.arange(0, width, step), axis=0)
                rest = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(ids)))]))
                out: list[list[np.ndarray]] = [[], [], []]
                for i, q in enumerate(q_ids.tolist()):
                    at, score = best(np.ascontiguousarray(asked_for[:, i]), columns, rest, step, top, ids == q)
                    order = np.lexsort((ids[at], -score))[:top]
                    for column, value in zip(out, (np.full(len(order), q), ids[at][order], score[order]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "id", "score"])

    found = pairs.select("ids", "matrix", "q_ids", "q_matrix").mapInArrow(searched, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
