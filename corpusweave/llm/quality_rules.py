"""Quality rules: plain document counts, then a hashed n-gram log-likelihood ratio per n-gram.

DataFrame functions only. The counts of two multinomials over hash buckets, one of trusted documents
and one of the raw corpus, give each bucket a ratio; a document's score is the mean ratio of its words
and word pairs. Ratios are kept as whole micro-nats, so sums and thresholds do not depend on the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16_384
PRIOR = 1_048_576  # n-grams of the raw corpus that smooth the trusted counts
THRESHOLD = -0.02  # nats per n-gram
MIN_WORDS = 50
_SPACE = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"
_SCALE = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _word_code(word: Column) -> Column:
    """The first 32 bits of the word's MD5 modulo the buckets, so that other engines can compute it: as the
    buckets are a power of two of at most 16 bits, the second half of these bits is enough."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 5, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def _grams(codes: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours, repeats included."""
    pair = F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: (a * 31 + b * 17 + 7) % BUCKETS,
    )
    return F.concat(codes, pair)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as empty. Repeated windows are found by sorting a document's own window hashes,
    so nothing leaves the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    windows = F.expr(
        "sort_array(transform(sequence(0, greatest(size(_words) - 3, 0)),"
        " i -> struct(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) as h, i as i)))"
    )
    # starts of windows that have an equal neighbour in hash order, in text order
    repeated = F.expr(
        "array_sort(filter(transform(_windows, (w, k) ->"
        " if(w.h = get(_windows, k - 1).h or w.h = get(_windows, k + 1).h, w.i, -1)), i -> i >= 0))"
    )
    # a window adds the words that the one before it does not hold
    covered = F.expr("aggregate(transform(_starts, (s, k) -> if(k = 0, 3, least(3, s - get(_starts, k - 1)))), 0L, (a, n) -> a + n)")
    return (
        docs.withColumn("_words", words_of(F.col(text_col)))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumns(
            {
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                "_lines": lines,
                "_windows": F.when(F.col("n_words") >= 3, windows),
            }
        )
        .withColumns(
            {
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "_starts": F.when(F.col("n_words") >= 3, repeated),
            }
        )
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        )
        .drop("_lines", "_windows", "_starts")
    )


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``ratios``, an array over buckets of the log-likelihood ratio trusted / raw in micro-nats.

    ``trusted`` holds ids. Counts are taken over all documents; one is added to each bucket of the raw
    counts, and the trusted counts are smoothed by PRIOR n-grams spread as in the raw corpus, so that a
    small trusted set says little. Only partial counts per bucket are shuffled; the result is as long
    as the bucket count.
    """
    # the trusted ids have no size bound, so they are merged with the documents and never broadcast
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    marked = docs.select(id_col, text_col).join(ids.withColumn("_trusted", F.lit(1)).hint("merge"), F.col(id_col) == F.col("_id"), "left")
    codes = F.transform(words_of(F.col(text_col)), _word_code)
    counts = (
        marked.select(F.coalesce("_trusted", F.lit(0)).cast("long").alias("t"), codes.alias("_codes"))
        .select("t", F.explode(_grams(F.col("_codes"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    every = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    table = full.agg(
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
    )
    smooth = f"(r.target + {PRIOR} * (r.raw / n_raw)) / (n_target + {PRIOR})"
    ratio = f"cast(round((ln({smooth}) - ln(r.raw / n_raw)) * {_SCALE}) as bigint)"
    return table.select(F.expr(f"transform(rows, r -> {ratio})").alias("ratios"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with the base counts, base_failed, n_grams, score_sum (micro-nats) and kept.

    kept is false if base_failed, else whether the mean ratio of the document's n-grams reaches
    ``threshold`` nats. ``trusted`` holds the ids of trusted documents; with none of them all ratios
    are 0 and the base rules decide. Empty tables give no rows; null ids are scored like others;
    columns of ``docs`` that have a result's name are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "score_sum", "kept"]
    ratios = bucket_ratios(docs, trusted, id_col, text_col)
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text"))
    scored = (
        base_counts(rows, "_text")
        .withColumn("_codes", F.transform("_words", _word_code))
        .withColumn("_grams", _grams(F.col("_codes")))
        .withColumn("_ratios", ratios.scalar())
        .withColumn("n_grams", F.size("_grams").cast("long"))
        .withColumn("score_sum", F.expr("aggregate(_grams, 0L, (a, g) -> a + _ratios[g])"))
        .withColumn("_place", F.monotonically_increasing_id())
    )
    limit = round(threshold * _SCALE)
    # a filter on kept must not be moved below the arrays above, where each use would compute them again
    settled = F.col("_place") >= 0
    kept = ~F.col("base_failed") & (F.col("score_sum") >= F.col("n_grams") * limit) & settled
    return scored.withColumn("kept", kept).select("_row.*", *added)
