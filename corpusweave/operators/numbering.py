"""Consecutive row numbers without one global sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.session import cut_lineage


def number_rows(df: DataFrame, order: list[str], output: str) -> DataFrame:
    """Add 0, 1, 2, ... in the given order, which must tell all rows apart.

    Rows are range partitioned, numbered within each range, and shifted by the rows before it. The
    ranges are checkpointed, as sampling their borders again could move a row.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(starts), "_range")  # one row per shuffle partition
        .withColumn(output, (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_range", "_place", "_start")
    )
