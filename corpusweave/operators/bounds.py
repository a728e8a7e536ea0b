"""Size checks that come before a broadcast, and the join used when the check fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.session import set_down

MAX_BROADCAST_CELLS = 8_000_000  # 64 MB of doubles
MAX_BROADCAST_ROWS = 1_000_000  # for narrow tables of a short string and a few numbers
SALTS = 16


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows."""
    return df.count() <= rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Column,
    *,
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Join ``facts`` to a table with one row per ``key``; ``small`` skips the size check if known.

    A lookup of checked size is broadcast. A larger one is shuffled, and since one key may hold a
    large part of ``facts``, both sides carry a salt that splits every key into ``SALTS`` parts.
    """
    if small if small is not None else fits(lookup, max_rows):
        return facts.join(F.broadcast(lookup), key, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def frequent_join(
    facts: DataFrame, lookup: DataFrame, key: str, spread_by: Column, frequency: DataFrame | None = None, *, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Inner join of ``facts`` to a table with one row per ``key``, of which few hold most of ``facts``.

    If the lookup is too large for a broadcast, its most frequent keys are broadcast all the same, as many
    as fit, and only facts of the other keys are shuffled. ``frequency`` (key, n) says how many facts a
    key has, about; it decides where a fact is joined, never whether. By default it is counted.
    """
    if fits(lookup, max_rows):
        return facts.join(F.broadcast(lookup), key)
    if frequency is None:
        frequency = set_down(facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "frequency")
    step = F.floor(F.log2("n") * 4)
    held, cut = 0, None
    for row in frequency.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundreds at most
        held += row["count"]
        if held > min(max_rows, MAX_BROADCAST_ROWS):
            break
        cut = row["step"]
    if cut is None:
        return lookup_join(facts, lookup, key, spread_by, small=False)
    often = F.broadcast(frequency.where(step >= cut).select(key))
    near = facts.join(F.broadcast(lookup.join(often, key, "left_semi")), key)
    far = lookup_join(facts.join(often, key, "left_anti"), lookup.join(often, key, "left_anti"), key, spread_by, small=False)
    return near.unionByName(far)


def per_cluster_join(
    rows: DataFrame, per_cluster: DataFrame, cluster: str, width: int, spread_by: Column
) -> DataFrame:
    """Give every row the one ``per_cluster`` record of its cluster (``width`` doubles wide)."""
    return lookup_join(
        rows, per_cluster, cluster, spread_by, max_rows=max(1, MAX_BROADCAST_CELLS // max(1, width))
    )


def task_count(spark: SparkSession) -> int:
    """How many tasks keep the cluster busy.

    The larger of the cores seen now and the shuffle partitions the user chose for the data, as a
    cluster that grows on demand reports few cores at first.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, partitions)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan read as fewer pieces than there are cores; else leave it as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
