"""The trie of conversation prefixes: which openings conversations share, and what sharing them saves.

A conversation is a sequence of turns; a node is a distinct sequence of first turns. Nodes are named by
128-bit sums over the turns, sum of hash(turn i) * BASE^i modulo 2^64 in two halves, so the name of every
prefix is a prefix sum. Turns are numbered and summed in ranges of the sorted table; a conversation that
goes on in the next range is carried over by one row per range, so its length does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.bytehash import BASE, INVERSE, powers
from corpusweave.llm.euler_tour import LIST_ROWS, SPLIT_CHILDREN, set_down, subtree_sums
from corpusweave.session import ship_package

WORD = r"[^\x20\x09-\x0D]+"
HEAD_TURNS = 3  # turns that a conversation may take from its base
JOIN_TURNS = 4_096  # turns of a conversation that meet its head in one group
PIECE_IDS = 65_536  # ids of one digest that are joined at a time
_MASK = (1 << 64) - 1
_SUMS = ("before_a", "before_b", "after_a", "after_b")
_KEY = ["key_a", "key_b", "depth"]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix sums of the turns of each conversation within one sorted range."""
    part = TaskContext.get().partitionId()
    conv, count, held = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ids = batch.column(0).to_numpy()
        halves = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, 2)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sizes = np.diff(np.r_[first, n])
        place = np.arange(n) - np.repeat(first, sizes)
        goes_on = int(sizes[0]) if conv == ids[0] else 0  # rows of the conversation that began in an earlier batch
        scale = powers(int(sizes.max()))[0][place]
        if goes_on:
            scale[:goes_on] *= np.uint64(pow(BASE, count, 1 << 64))
        columns = []
        for k in range(2):
            after = np.cumsum(halves[:, k] * scale)
            start = np.r_[np.uint64(0), after[first[1:] - 1]]
            after -= np.repeat(start, sizes)
            if goes_on:
                after[:goes_on] += np.uint64(held[k])
            before = np.r_[np.uint64(held[k] if goes_on else 0), after[:-1]]
            before[first[1:]] = 0
            columns.append((before, after))
        place[:goes_on] += count
        conv, count, held = ids[-1], int(place[-1]) + 1, [int(c[1][-1]) for c in columns]
        (before_a, after_a), (before_b, after_b) = columns
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(place), batch.column(2),
             _signed(before_a), _signed(before_b), _signed(after_a), _signed(after_b)],
            ["conv", "part", "place", "words", *_SUMS],
        )


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, place, words, before_a, before_b, after_a, after_b) of every turn; texts stay behind.

    ``place`` counts from 0 in the order of ``turn_col`` (nulls first; equal ones by the MD5 of role and
    text). The sums are those of the prefixes before and with the turn.
    """
    spark = turns.sparkSession
    ship_package(spark)
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.rand(0).alias("salt"),
    )
    # the salt spreads rows that are equal in all the rest, whose order is of no account
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("salt")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")
    found = set_down(ranged.mapInArrow(_numbered, "conv long, part int, place long, words long, " + ", ".join(f"{s} long" for s in _SUMS)), "turns")
    pieces = found.groupBy("conv", "part").agg(F.max("place").alias("last"), F.max_by(F.struct("after_a", "after_b"), "place").alias("after"))
    split = pieces.groupBy("conv").count().where("count > 1").select("conv")
    carried, offsets = {}, {}
    # only the first and the last conversation of a range go on elsewhere: two rows per range at most
    for row in pieces.join(split, "conv").orderBy("conv", "part").collect():
        count, sums = carried.get(row["conv"], (0, (0, 0)))
        offsets[row["conv"], row["part"]] = (count, sums)
        scale = pow(BASE, count, 1 << 64)
        carried[row["conv"]] = (
            count + row["last"] + 1,
            tuple((s + scale * (own & _MASK)) & _MASK for s, own in zip(sums, row["after"], strict=True)),
        )
    if not offsets:
        return found.drop("part")
    shared = spark.sparkContext.broadcast(offsets)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place = batch.column(2).to_numpy().copy()
            sums = [c.to_numpy().view(np.uint64).copy() for c in batch.columns[4:]]
            first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])]) if len(ids) else np.zeros(0, int)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                count, start = known.get((int(ids[a]), int(parts[a])), (0, None))
                if start is None:
                    continue
                place[a:b] += count
                scale = np.uint64(pow(BASE, count, 1 << 64))
                for k, column in enumerate(sums):
                    column[a:b] = column[a:b] * scale + np.uint64(start[k % 2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place), batch.column(3), *map(_signed, sums)], ["conv", "place", "words", *_SUMS]
            )

    return found.mapInArrow(shifted, "conv long, place long, words long, " + ", ".join(f"{s} long" for s in _SUMS))


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the prefixes that end in an own turn, after the turns taken from the base."""
    for batch in batches:
        conv, place, words, length, skip, taken, own_a, own_b, base_a, base_b, *sums = batch.columns
        shift = (skip.to_numpy() - taken.to_numpy()).astype(np.int64)  # turns skipped and not replaced
        scale = np.array([pow(INVERSE, s, 1 << 64) for s in range(int(shift.max(initial=0)) + 1)], np.uint64)[shift]
        keys = []
        for k, column in enumerate(sums):
            own, base = ((own_a, base_a), (own_b, base_b))[k % 2]
            gap = column.to_numpy().view(np.uint64) - own.to_numpy().view(np.uint64)
            keys.append(_signed(gap * scale + base.to_numpy().view(np.uint64)))
        at = place.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [conv, pa.array(at + 1 - shift), words, *keys, pa.array(at + 1 == length.to_numpy())],
            ["conv", "depth", "words", "parent_a", "parent_b", "key_a", "key_b", "ends"],
        )


def prefixes(turns: DataFrame, base: Column | None = None, skip: Column | None = None, most: int = HEAD_TURNS) -> DataFrame:
    """(conv, depth, words, parent_a, parent_b, key_a, key_b, ends): one row per conversation and prefix.

    ``turns`` are those of :func:`ordered_turns`. Conversation ``conv`` starts with the first ``skip``
    (at most ``most``) turns of conversation ``base``, all if it has fewer and none if it is absent, and
    goes on with its own turns after its first ``skip``. Without them it is as it stands. The root has
    depth 0 and belongs to every conversation, also one without turns.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    heads = turns.where(F.col("place") < most).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "words", "after_a", "after_b"))).alias("head")  # at most ``most`` each
    )
    skip = F.lit(0) if skip is None else skip
    own = lengths.join(heads, "conv").select(
        "conv", "length", "head", F.least(skip, F.lit(most)).cast("long").alias("skip"), (F.col("conv") if base is None else base).alias("base")
    )
    other = heads.select(F.col("conv").alias("base"), F.expr("head").alias("opening"))
    known = own.join(other, "base", "left").withColumn("taken", F.least(F.col("skip"), F.coalesce(F.size("opening"), F.lit(0)).cast("long")))
    nothing = F.lit(0).cast("long")

    def reached(head: str, turns: str, half: str) -> Column:
        return F.when(F.col(turns) == 0, nothing).otherwise(F.get(F.col(head), F.col(turns).cast("int") - 1)[f"after_{half}"])

    known = set_down(
        known.select(
            "conv", "length", "skip", "taken", "opening",
            *[reached("head", "skip", h).alias(f"own_{h}") for h in "ab"], *[reached("opening", "taken", h).alias(f"base_{h}") for h in "ab"],
        ),
        "heads",
    )
    spread = known.where("length > skip").drop("opening").withColumn("block", F.explode(F.expr(f"sequence(0, (length - 1) div {JOIN_TURNS})")))
    later = turns.withColumn("block", F.expr(f"place div {JOIN_TURNS}")).join(spread, ["conv", "block"]).where("place >= skip")
    columns = "conv long, depth long, words long, parent_a long, parent_b long, key_a long, key_b long, ends boolean"
    own_rows = later.select("conv", "place", "words", "length", "skip", "taken", "own_a", "own_b", "base_a", "base_b", *_SUMS).mapInArrow(_spliced, columns)
    bare = F.col("length") <= F.col("skip")
    root = known.select(
        "conv", nothing.alias("depth"), nothing.alias("words"), F.lit(None).cast("long").alias("parent_a"), F.lit(None).cast("long").alias("parent_b"),
        nothing.alias("key_a"), nothing.alias("key_b"), (bare & (F.col("taken") == 0)).alias("ends"),
    )
    opened = known.where("taken > 0").select("*", F.posexplode(F.slice("opening", F.lit(1), F.col("taken").cast("int"))).alias("at", "turn"))
    earlier = [F.when(F.col("at") == 0, nothing).otherwise(F.get("opening", F.col("at") - 1)[f"after_{h}"]).alias(f"parent_{h}") for h in "ab"]
    shared = opened.select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "turn.words", *earlier, F.col("turn.after_a").alias("key_a"), F.col("turn.after_b").alias("key_b"),
        (bare & (F.col("at") + 1 == F.col("taken"))).alias("ends"),
    )
    return own_rows.unionByName(shared).unionByName(root)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node, joined by commas, PIECE_IDS at most in a row."""
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        n = batch.num_rows
        if n == 0:
            continue
        fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]
        first = np.flatnonzero(fresh)
        cuts = np.unique(np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(first, [*first[1:], n], strict=True)]))
        ids = columns[3].astype(str).tolist()
        texts = [",".join(ids[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[cuts]) for c in columns], pa.array(texts, pa.string())], [*_KEY, "first", "piece"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, one piece in memory at a time."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*_KEY, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], [*_KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key_a, key_b, depth, ends_sha256) over the ascending ids of the conversations that end in a node.

    A node with very many ends is split over the sorted ranges; only its joined pieces meet in a task.
    """
    ranged = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").select(*_KEY, "conv")
    pieces = ranged.mapInArrow(_joined_ids, "key_a long, key_b long, depth long, first long, piece string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digested, "key_a long, key_b long, depth long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, base: Column | None = None, skip: Column | None = None, most: int = HEAD_TURNS,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    few: int = LIST_ROWS, split: int = SPLIT_CHILDREN,
) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and ``words`` (of its last turn).

    A conversation is a member of the nodes of all its prefixes, the root included. n_leaves and
    saved_tokens, the (n_convs - 1) * words of every node, are summed over the subtree. ``base`` and
    ``skip`` are columns over ``conv`` that say which first turns a conversation takes from another one,
    see :func:`prefixes`.

    Turns stand in the order of ``turn_col``, null first, equal ones by the MD5 of role and text, repeated
    rows as turns of their own. Null roles and texts are empty; rows without a conversation id belong to
    none and are left out; the empty table has no node. Ids are whole numbers. Other columns are not read.
    """
    turns = ordered_turns(conversations, conv_col, turn_col, role_col, text_col)
    rows = set_down(prefixes(turns, base, skip, most), "prefixes")
    found = rows.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b")
    )
    # the ids are set down with the nodes, so that they stay as they are
    nodes = set_down(found.withColumn("id", F.monotonically_increasing_id()), "nodes")
    up = [F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b"), (F.col("depth") - 1).alias("depth")]
    counted = nodes.where("depth > 0").select(*up).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(counted, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = set_down(nodes.join(end_digests(rows.where("ends")), _KEY, "left"), "nodes")
    # parents with very many children stand in several buckets, as do their children
    heavy = nodes.where(F.col("n_children") > split).select(*_KEY, F.ceil(F.col("n_children") / split).alias("buckets"))
    above = nodes.where("n_children > 0").join(F.broadcast(heavy), _KEY, "left").select(  # at most one row per ``split`` nodes
        *_KEY, F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.expr("sequence(0, coalesce(buckets, 1) - 1)")).alias("bucket")
    )
    below = nodes.where("depth > 0").select("id", *up).join(F.broadcast(heavy), _KEY, "left")
    below = below.withColumn("bucket", F.pmod(F.xxhash64("id"), F.coalesce("buckets", F.lit(1)))).drop("buckets")
    parents = below.join(above, [*_KEY, "bucket"]).select("id", "parent", "parent_conv_id")
    family = set_down(nodes.drop("parent_a", "parent_b").join(parents, "id", "left"), "family")
    saved = (F.col("n_convs") - 1) * F.col("words")
    valued = family.select("id", "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    sums = subtree_sums(valued, ["n_leaves", "saved_tokens"], few, split)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return family.join(sums, "id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "words"
    )
