"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document has a rate, the expected number of its copies. Among all rates between 0 and ``MOST``
whose words meet each source's target, those nearest to 1 in relative entropy are
``min(MOST, exp(tilt * size / mean size))`` with one tilt per source: the solution of a convex dual,
found by Newton steps over the histogram of sizes. Rates are then rounded to whole copies.

All sums are of whole numbers, so reruns agree to the last document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.session import cut_lineage, scratch_path

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
MOST = 3  # copies of a document, and words of a source against its size
BINS = 64  # hash bins in which documents of about one size are rounded together
CLASSES = 24  # powers of two of the size; longer documents share the last class
STEPS = 80  # Newton steps before giving up
_WORD = "[^\\x20\\x09-\\x0D]+"
_FINE = 1_000_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, k, source_size, target): ``sizes`` holds source and size, one row per document.

    Sources are numbered by code point, null last. They share all words by weight; a source takes no
    more than MOST times its size, and what it leaves goes to the others by weight. The level at which
    that stops is found from prefix sums over the sources in the order in which they fill up. One row
    per source is all that meets in a task.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = own.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    filled = numbered.withColumn("w", weight).withColumns(
        {"most": MOST * F.col("source_size"), "full_at": MOST * F.col("source_size") / F.col("w")}
    )
    order = Window.orderBy("full_at", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.sum("most").over(order) + F.col("most")) / (
        F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w")
    )
    leveled = filled.withColumns({"level": level, "at": F.row_number().over(Window.orderBy("full_at", "k"))})
    first = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("at", "level"))).over(everything)
    return leveled.withColumn("stop", first["level"]).select(
        "source", "k", "source_size", F.least(F.col("most").cast("double"), F.col("w") * F.col("stop")).alias("target")
    )


def _rate() -> Column:
    return F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(MOST))))


def _fixed(value: Column, times: Column, scale: int) -> Column:
    """sum of value * times, as a whole number of 1/scale: exact whatever the order of addition."""
    return F.sum(F.round(value * scale).cast("decimal(18,0)") * times.cast("decimal(20,0)"))


def tilts(cells: DataFrame, targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """``targets`` with ``mean`` and ``tilt``; ``cells`` holds (k, size, n), the histogram of sizes.

    Each step is one job over the histogram; its state (one row per source) goes to the checkpoint
    folder. A Newton step that leaves the known bracket is replaced by halving or doubling. Steps end
    when each source is within half a word plus a millionth of its target.
    """
    means = cells.groupBy("k").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = cut_lineage(
        targets.join(means, "k", "left").withColumns(
            {"mean": F.coalesce("mean", F.lit(1.0)), "tilt": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": F.lit(False)}
        )
    )
    columns = state.columns
    for _ in range(steps):
        words, slope = F.col("n") * F.col("size"), F.col("size") / F.col("mean")
        open_ = F.col("tilt") * slope < math.log(MOST)
        sums = (
            cells.join(state.where(~F.col("done")).select("k", "tilt", "mean"), "k")
            .groupBy("k")
            .agg(
                (_fixed(_rate(), words, _FINE).cast("double") / _FINE).alias("words"),
                (_fixed(F.when(open_, _rate() * slope).otherwise(0.0), words, 1_000_000).cast("double") / 1_000_000).alias("gain"),
            )
        )
        joined = state.join(sums, "k", "left").withColumn("gap", F.coalesce(F.col("words") - F.col("target"), F.lit(0.0)))
        bounded = joined.withColumns(
            {
                "low": F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")),
                "done": F.col("done") | (F.abs("gap") <= 0.5 + F.col("target") * 1e-6),
            }
        )
        newton = F.when(F.col("gain") > 0, F.col("tilt") - F.col("gap") / F.col("gain"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        other = (
            F.when(F.col("high") == float("inf"), F.greatest(F.col("tilt") * 2, F.lit(1.0)))
            .when(F.col("low") == float("-inf"), F.least(F.col("tilt") * 2, F.lit(-1.0)))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        step = F.when(F.col("done"), F.col("tilt")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(other)
        state = cut_lineage(bounded.withColumn("tilt", step).select(*columns))
        if not state.where(~F.col("done")).take(1):
            return state.drop("low", "high", "done")
    raise RuntimeError(f"the tilts did not settle in {steps} steps")


def _slot(id_col: str) -> Column:
    """Size class (longest first) and hash bin of a document, as one number."""
    size_class = F.least(F.floor(F.log2(F.greatest("size", F.lit(1)))), F.lit(CLASSES - 1))
    return ((CLASSES - 1 - size_class) * BINS + F.pmod(F.xxhash64(id_col, "size"), F.lit(BINS))).cast("int")


def mixing_plan(sized: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target, mean, tilt and ``extra``, an array of booleans
    by slot: whether documents of that size class and hash bin get the copy that their rate's fraction
    stands for.

    ``sized`` holds ``id_col``, source and size. Slots are decided from the longest class to the
    shortest, each taking or leaving its words and passing the rest on, so that the words taken end
    near the target. A source has CLASSES * BINS slots whatever its size, and slots are summed before
    they meet.
    """
    targets = cut_lineage(source_targets(sized, weights))
    number = targets.select(F.col("source").alias("_source"), "k")
    cells = cut_lineage(
        sized.where("size > 0").join(number, F.col("source").eqNullSafe(F.col("_source"))).groupBy("k", "size").agg(F.count("*").alias("n"))
    )
    solved = tilts(cells, targets)
    known = solved.select(F.col("source").alias("_source"), "k", "tilt", "mean")
    rated = sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", _rate())
    part = F.round((F.col("rate") - F.floor("rate")) * 1_000_000).cast("long")
    slots = (
        rated.where(part > 0)
        .groupBy("k", _slot(id_col).alias("slot"))
        .agg(F.sum("size").alias("mass"), F.sum(part * F.col("size")).alias("due"))
    )
    takes = "acc.left + g.due >= g.mass * 500000"
    fold = f"""aggregate(array_sort(collect_list(struct(slot, mass, due))),
        named_struct('left', 0L, 'taken', cast(array() as array<int>)),
        (acc, g) -> named_struct(
            'left', acc.left + g.due - if({takes}, g.mass * 1000000, 0L),
            'taken', if({takes}, concat(acc.taken, array(g.slot)), acc.taken)),
        acc -> transform(sequence(0, {CLASSES * BINS - 1}), i -> array_contains(acc.taken, i)))"""
    extra = slots.groupBy("k").agg(F.expr(fold).alias("extra"))
    return cut_lineage(solved.join(extra, "k", "left").drop("k"))


def _copies(id_col: str) -> Column:
    rate = F.round(_rate() * 1_000_000).cast("long")  # as the plan saw it
    whole, part = F.floor(_rate()).cast("int"), F.round((_rate() - F.floor(_rate())) * 1_000_000)
    taken = (part > 0) & F.coalesce(F.col("extra")[_slot(id_col)], F.lit(False))
    return F.when((F.col("size") > 0) & (rate > 0), whole + taken.cast("int")).otherwise(0)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """One row per document: id, size (words), source_size, target, copies (0 to MOST), taken.

    A null text has size 0; documents of size 0 get no copy; null is a source of its own; repeated
    rows each count and round alike; an empty table gives no rows; other columns are not read. The
    plan (one bounded row per source) is joined to narrow rows, so a hot source is never gathered.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "sizes")
    docs.select(id_col, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).write.parquet(path)
    sized = spark.read.parquet(path)
    plan = mixing_plan(sized, id_col, weights).withColumnRenamed("source", "_source")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", _copies(id_col))
        .select(id_col, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def repeat_to_weights(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, or up to MOST times)."""
    sized = docs.select(id_col, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    path = scratch_path(docs.sparkSession, "sizes")
    sized.write.parquet(path)
    plan = mixing_plan(docs.sparkSession.read.parquet(path), id_col, weights).withColumnRenamed("source", "_source")
    own = F.struct(*docs.columns).alias("_row")
    rows = docs.select(own, F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    copied = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(id_col))
    return copied.select("_row", F.explode(F.expr("array_repeat(0, copies)"))).select("_row.*")
