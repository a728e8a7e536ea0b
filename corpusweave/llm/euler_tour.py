"""Subtree sums of a forest held as a table: Euler tour, distributed list ranking, prefix sums.

Every node has an enter arc (2 * id) and an exit arc (2 * id + 1). The arcs of a tree form one list: an
enter arc is followed by the enter arc of the first child, an exit arc by that of the next sibling. The
place of every arc in the list comes from list ranking: in each round an independent set of arcs, chosen
by coins, is taken out and its neighbours are joined, until few are left; then all are put back in the
opposite order. A node's subtree is what lies between its two arcs, so its sums are differences of prefix
sums over the places. Neither the depth of the tree nor the number of children of a node matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.session import scratch_path, ship_package

LIST_ROWS = 65_536  # arcs that are ranked in one task when the rounds are over
SPLIT_CHILDREN = 4_096  # children of one node that are put in order together
BLOCK = 65_536  # places whose prefix sums are taken together


def set_down(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def tour_arcs(nodes: DataFrame, split: int = SPLIT_CHILDREN) -> DataFrame:
    """Arcs (id, pred, succ) of the tour over ``nodes`` (id, parent: null for a root, n_children).

    Children of one node stand in the order (bucket, id), where a node with more than ``split`` children
    has as many buckets as it needs to keep each near ``split``; so no window holds all of them. With
    several roots each tree has a list of its own.
    """
    heavy = nodes.where(F.col("n_children") > split).select(F.col("id").alias("parent"), F.ceil(F.col("n_children") / split).alias("buckets"))
    kids = (
        nodes.where("parent is not null")
        .select("id", "parent")
        .join(F.broadcast(heavy), "parent", "left")  # one row per split children at most: 4,096 times fewer than nodes
        .select("id", "parent", F.pmod(F.xxhash64("id"), F.coalesce("buckets", F.lit(1))).alias("bucket"))
    )
    own = Window.partitionBy("parent", "bucket").orderBy("id")
    linked = set_down(kids.withColumns({"before": F.lag("id").over(own), "after": F.lead("id").over(own)}), "siblings")
    ends = linked.where("before is null or after is null").groupBy("parent", "bucket").agg(
        F.min(F.when(F.col("before").isNull(), F.col("id"))).alias("first"), F.max(F.when(F.col("after").isNull(), F.col("id"))).alias("last")
    )
    across = Window.partitionBy("parent").orderBy("bucket")  # buckets of one parent: its children / split
    ends = set_down(
        ends.withColumns({"earlier": F.lag("last").over(across), "later": F.lead("first").over(across)}), "sibling-buckets"
    )
    closed = linked.join(ends.select("parent", "bucket", "earlier", "later"), ["parent", "bucket"]).select(
        "id",
        "parent",
        F.when(F.col("before").isNull(), F.col("earlier")).otherwise(F.col("before")).alias("before"),
        F.when(F.col("after").isNull(), F.col("later")).otherwise(F.col("after")).alias("after"),
    )
    of_parent = ends.groupBy("parent").agg(
        F.min(F.when(F.col("earlier").isNull(), F.col("first"))).alias("first_child"),
        F.max(F.when(F.col("later").isNull(), F.col("last"))).alias("last_child"),
    )
    around = nodes.select("id").join(closed, "id", "left").join(of_parent.withColumnRenamed("parent", "id"), "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    arcs = F.array(
        F.struct(
            enter.alias("id"),
            F.coalesce(F.col("before") * 2 + 1, F.col("parent") * 2).alias("pred"),
            F.coalesce(F.col("first_child") * 2, leave).alias("succ"),
        ),
        F.struct(
            leave.alias("id"),
            F.coalesce(F.col("last_child") * 2 + 1, enter).alias("pred"),
            F.coalesce(F.col("after") * 2, F.col("parent") * 2 + 1).alias("succ"),
        ),
    )
    return around.select(F.explode(arcs).alias("arc")).select("arc.*")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos) of the few arcs left, by pointer jumping towards the heads of their lists."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("pred", pa.int64()), ("gap", pa.int64())]))
    if rows.num_rows == 0:
        return
    rows = rows.sort_by("id")
    ids, gap = rows["id"].to_numpy(), rows["gap"].to_numpy().copy()
    head = rows["pred"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    at = np.where(head, np.arange(len(ids)), np.searchsorted(ids, rows["pred"].combine_chunks().fill_null(0).to_numpy()))
    gap[head] = 0
    while not np.array_equal(further := at[at], at):
        gap = gap + gap[at]
        at = further
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gap)], ["id", "pos"])


def rank_list(arcs: DataFrame, few: int = LIST_ROWS) -> DataFrame:
    """(id, pos): the place, from 0, of every element of the lists given by (id, pred, succ).

    Random mates: in each round an element goes if its coin shows 1 and that of its forerunner 0, about a
    quarter of all, never two neighbours. It tells its neighbours of each other, in one aggregation, and
    is set down with the distance to its forerunner. At most ``few`` elements are ranked in one task.
    """
    ship_package(arcs.sparkSession)

    def coin(element: str, turn: int) -> Column:
        return F.xxhash64(F.col(element), F.lit(turn)).bitwiseAND(F.lit(1)) == 1

    active = set_down(arcs.select("id", "pred", "succ", F.lit(1).cast("long").alias("gap")), "arcs")
    taken: list[DataFrame] = []
    while active.count() > few:
        turn = len(taken)
        goes = F.coalesce(coin("id", turn) & F.col("pred").isNotNull() & ~coin("pred", turn), F.lit(False))
        marked = active.withColumn("goes", goes)
        taken.append(set_down(marked.where("goes").select("id", "pred", "succ", "gap"), "arcs-out"))
        none, quiet = F.lit(None).cast("long"), F.lit(False)
        stay = marked.where("not goes").select("id", "pred", "succ", "gap", quiet.alias("to_succ"), quiet.alias("to_pred"))
        told = taken[-1].select(
            F.explode(
                F.array(
                    F.struct(F.col("succ").alias("id"), "pred", none.alias("succ"), "gap", F.lit(True).alias("to_succ"), quiet.alias("to_pred")),
                    F.struct(F.col("pred").alias("id"), none.alias("pred"), "succ", F.lit(0).cast("long").alias("gap"), quiet.alias("to_succ"), F.lit(True).alias("to_pred")),
                )
            ).alias("m")
        ).select("m.*").where("id is not null")
        both = stay.unionByName(told).groupBy("id").agg(
            F.max(F.when(F.col("to_succ"), F.col("pred"))).alias("new_pred"),
            F.max(F.when(~F.col("to_succ") & ~F.col("to_pred"), F.col("pred"))).alias("pred"),
            F.max(F.when(F.col("to_pred"), F.col("succ"))).alias("new_succ"),
            F.max(F.when(~F.col("to_succ") & ~F.col("to_pred"), F.col("succ"))).alias("succ"),
            F.sum("gap").alias("gap"),
            F.max("to_succ").alias("joined"),
            F.max("to_pred").alias("cut"),
        )
        active = set_down(
            both.select(
                "id",
                F.when(F.col("joined"), F.col("new_pred")).otherwise(F.col("pred")).alias("pred"),
                F.when(F.col("cut"), F.col("new_succ")).otherwise(F.col("succ")).alias("succ"),
                "gap",
            ),
            "arcs",
        )
    places = active.select("id", "pred", "gap").repartition(1).mapInArrow(_walk, "id long, pos long")  # at most ``few`` rows
    for gone in reversed(taken):
        places = set_down(places, "places")
        back = gone.select("id", F.col("pred").alias("at"), "gap").join(places.withColumnRenamed("id", "at"), "at")
        places = places.union(back.select("id", F.col("pos") + F.col("gap")))
    return set_down(places, "places")


def subtree_sums(nodes: DataFrame, values: list[str], few: int = LIST_ROWS, split: int = SPLIT_CHILDREN, block: int = BLOCK) -> DataFrame:
    """(id, value ...): each of the whole-number ``values`` summed over the subtree of every node.

    ``nodes`` holds one tree: id, parent (null for its root), n_children and the values. Sums of whole
    blocks of places come first, so a window holds one block or one row per block.
    """
    places = rank_list(tour_arcs(nodes, split), few)
    arcs = places.select(F.expr("id div 2").alias("id"), (F.col("id") % 2 == 0).alias("enter"), "pos")
    weighed = arcs.join(nodes.select("id", *values), "id").withColumn("block", F.expr(f"pos div {block}"))
    weighed = set_down(weighed.select("id", "enter", "pos", "block", *[F.when(F.col("enter"), F.col(v)).otherwise(0).alias(v) for v in values]), "weighed")
    so_far = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    whole = weighed.groupBy("block").agg(*[F.sum(v).alias(v) for v in values])
    before = whole.select("block", *[F.coalesce(F.sum(v).over(so_far), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("block").orderBy("pos")
    summed = weighed.select("id", "enter", "block", *[F.sum(v).over(inside).alias(v) for v in values], *[F.col(v).alias(f"own_{v}") for v in values])
    summed = summed.join(F.broadcast(before), "block")
    at = {v: F.col(v) + F.col(f"_{v}") for v in values}
    return summed.groupBy("id").agg(
        *[(F.max(F.when(~F.col("enter"), at[v])) - F.max(F.when(F.col("enter"), at[v] - F.col(f"own_{v}")))).alias(v) for v in values]
    )
