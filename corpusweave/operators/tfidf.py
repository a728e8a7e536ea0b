"""TF-IDF: relational statistics, a fitted vocabulary, and sparse vectors without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.functions import text as tx
from corpusweave.operators.bounds import MAX_BROADCAST_ROWS, frequent_join
from corpusweave.operators.numbering import number_rows
from corpusweave.session import cut_lineage

# A vocabulary of at most this many terms is held on the driver and in every task.
MAX_MODEL_TERMS = 1_000_000


@dataclass(frozen=True)
class TfidfConfig:
    ngram_range: tuple[int, int] = (1, 1)
    max_features: int | None = 50_000
    min_df: int | float = 2
    max_df: int | float = 0.95
    lowercase: bool = True


def document_terms(docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text") -> DataFrame:
    """``docs`` plus an array column ``grams``."""
    tokens = tx.terms(F.coalesce(F.col(text), F.lit("")), lower=config.lowercase)
    tokenized = docs.withColumn("_tokens", tokens)
    return tokenized.withColumn("grams", tx.ngrams(F.col("_tokens"), *config.ngram_range)).drop("_tokens")


def term_frequency(docs_with_grams: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, term, tf)``. Counting runs inside each row, so the corpus is not shuffled."""
    ordered = docs_with_grams.select(key, F.sort_array("grams").alias("grams")).withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("grams")),
            lambda i: (i == 0)
            | (i == F.size("grams"))
            | (F.get("grams", i) != F.get("grams", i - 1)),
        ),
    )
    # `starts` holds where each run of equal terms begins, and the array's size at the end.
    counted = F.transform(
        F.slice("starts", 1, F.size("starts") - 1),
        lambda start, i: F.struct(
            F.get("grams", start).alias("term"),
            (F.get("starts", i + 1) - start).cast("bigint").alias("tf"),
        ),
    )
    return (
        ordered.select(key, F.explode(counted).alias("count"))
        .select(key, "count.term", "count.tf")
    )


def document_frequency(frequencies: DataFrame) -> DataFrame:
    """``(term, df, total_tf)``: documents and occurrences per term."""
    return frequencies.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
    )


def within_df_bounds(
    statistics: DataFrame, n_docs: Column | int, min_df: int | float = 2, max_df: int | float = 0.95
) -> DataFrame:
    """Keep terms by document frequency; an int bound is a count, a float a share of all documents."""
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)

    def bound(value: int | float) -> Column:
        if isinstance(value, bool) or value < 0:
            raise ValueError("document frequency bounds must be counts or shares")
        if isinstance(value, int):
            return F.lit(value)
        if value > 1.0:
            raise ValueError("a share of documents must lie between 0.0 and 1.0")
        return F.lit(value) * n_docs

    return statistics.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))


def most_frequent(statistics: DataFrame, max_features: int | None) -> DataFrame:
    """The ``max_features`` terms with the highest corpus total, ties by term.

    A histogram of the totals on a logarithmic scale finds the step that holds the last kept term,
    so the final sort sees little more than the terms it keeps. The histogram reads the same
    shuffled counts as the selection.
    """
    if max_features is None:
        return statistics
    step = F.floor(F.log2("total_tf") * 16)
    histogram = statistics.select(step.alias("step")).groupBy("step").count()
    running = F.sum("count").over(
        Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = (
        histogram.withColumn("reached", running)
        .where(F.col("reached") >= max_features)
        .agg(F.max("step"))
        .scalar()
    )
    return (
        statistics.where(step >= F.coalesce(cut, F.lit(0)))
        .orderBy(F.desc("total_tf"), "term")
        .limit(max_features)
    )


def with_term_index(vocabulary: DataFrame, bounded: bool = True) -> DataFrame:
    """Number the terms alphabetically from 0; a bounded vocabulary fits one sorted partition."""
    if not bounded:
        numbered = number_rows(vocabulary, ["term"], "term_index")
        return numbered.withColumn("term_index", F.col("term_index").cast("int"))
    position = F.row_number().over(Window.orderBy("term")) - 1
    return vocabulary.withColumn("term_index", position.cast("int"))


def idf(df: Column, n_docs: Column | int) -> Column:
    """Smoothed inverse document frequency."""
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def vocabulary(docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(term, df, total_tf, term_index, idf)`` of a corpus, as one lazy plan."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    counts = term_frequency(document_terms(docs.select(key, text), config, text), key)
    kept = most_frequent(
        within_df_bounds(document_frequency(counts), n_docs, config.min_df, config.max_df),
        config.max_features,
    )
    bounded = config.max_features is not None and config.max_features <= MAX_MODEL_TERMS
    return with_term_index(kept, bounded).withColumn("idf", idf(F.col("df"), n_docs))


class TfidfModel:
    """A fitted vocabulary that turns documents into normalised TF-IDF vectors.

    The vocabulary is kept sorted, so a term's place is its vector index. Up to
    ``MAX_MODEL_TERMS`` terms it travels with the tasks and transforming a document touches no
    other row. A larger one stays a table and is joined (see :meth:`weights`).
    """

    def __init__(self, config: TfidfConfig, table: DataFrame, n_docs: int):
        self.config = config
        self.n_docs = n_docs
        self._table = table
        self.n_terms = table.count()
        self.small = self.n_terms <= MAX_MODEL_TERMS
        self._rows = table.orderBy("term_index").collect() if self.small else None

    @property
    def vocabulary(self) -> DataFrame:
        return self._table

    @property
    def feature_names(self) -> list[str]:
        if not self.small:
            raise ValueError("the vocabulary is unbounded; read it from the vocabulary table")
        return [row["term"] for row in self._rows]

    def vectors(self, docs: DataFrame, text: str = "text", output: str = "tfidf") -> DataFrame:
        """``docs`` plus a sparse unit vector per document; no terms gives a zero vector."""
        if not self.small:
            raise ValueError(
                f"vectors need max_features <= {MAX_MODEL_TERMS}; use weights() for more terms"
            )
        if not self._rows:
            raise ValueError("no terms remain; relax min_df, max_df or the stopwords")
        counter = _count_model(docs.sparkSession, self.feature_names)
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([row["idf"] for row in self._rows]),
            inputCol="_counts",
            outputCol="_scaled",
        )
        unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=output)
        grams = document_terms(docs, self.config, text)
        result = unit.transform(scale.transform(counter.transform(grams)))
        return result.drop("grams", "_counts", "_scaled")

    def weights(
        self, docs: DataFrame, text: str = "text", key: str = "doc_id", keep_empty: bool = False
    ) -> DataFrame:
        """``(doc_id, term, weight)``.

        A document without any known term has no row, or with ``keep_empty`` one row with a null
        term and weight 0.
        """
        names = self._table.select("term", "term_index")
        if self.small:
            vectors = self.vectors(docs.select(key, text), text)
            long = entries(vectors, "tfidf", [key], keep_empty)
            named = long.join(F.broadcast(names), "term_index", "left" if keep_empty else "inner")
            return named.select(key, "term", "weight")
        counts = term_frequency(document_terms(docs.select(key, text), self.config, text), key)
        frequency = self._table.select("term", F.col("df").alias("n"))
        known = frequent_join(counts, self._table.select("term", "idf"), "term", F.col(key), frequency, max_rows=MAX_BROADCAST_ROWS)
        raw = known.withColumn("raw", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
        weights = raw.select(key, "term", (F.col("raw") / norm).alias("weight"))
        if not keep_empty:
            return weights
        filled = docs.select(key).join(weights, key, "left")
        return filled.withColumn("weight", F.coalesce("weight", F.lit(0.0)))

    def shape(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``(n_docs, n_terms, non_zeros)`` of the matrix for ``docs``."""
        stored = self.weights(docs, text, key).agg(F.count(F.lit(1))).scalar()
        return docs.agg(F.count(F.lit(1)).alias("n_docs")).select(
            "n_docs",
            F.lit(self.n_terms).cast("bigint").alias("n_terms"),
            stored.alias("non_zeros"),
        )

    def save(self, path: str) -> None:
        low, high = self.config.ngram_range
        table = self._table.select(
            "*",
            F.lit(self.n_docs).cast("bigint").alias("n_docs"),
            F.lit(low).alias("ngram_low"),
            F.lit(high).alias("ngram_high"),
            F.lit(self.config.lowercase).alias("lowercase"),
        )
        table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        table = spark.read.parquet(path)
        first = table.first()
        config = TfidfConfig(
            ngram_range=(first["ngram_low"], first["ngram_high"]), lowercase=first["lowercase"]
        )
        kept = table.drop("n_docs", "ngram_low", "ngram_high", "lowercase")
        return cls(config, kept, first["n_docs"])


def _count_model(spark: SparkSession, terms: list[str]) -> CountVectorizerModel:
    # `from_vocabulary` copies term by term over the gateway; one joined string takes a single call.
    words = spark._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms))
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", words
    )
    return model.setInputCol("grams").setOutputCol("_counts")


def fit_tfidf(docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text", key: str = "doc_id") -> TfidfModel:
    """Fit the vocabulary once and keep it as a checkpointed table; contradictory bounds are an error."""
    n_docs = docs.count()
    low, high = (bound if isinstance(bound, int) else bound * n_docs for bound in (config.min_df, config.max_df))
    if high < low:
        raise ValueError(f"max_df stands for {high:g} documents, fewer than the {low:g} of min_df")
    return TfidfModel(config, cut_lineage(vocabulary(docs, config, text, key)), n_docs)


def entries(df: DataFrame, vector: str, keep: list[str], keep_empty: bool = False) -> DataFrame:
    """Non-zero entries of a sparse ML vector column as ``(*keep, term_index, weight)``."""
    parts = F.unwrap_udt(F.col(vector))
    pairs = F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("v"))
    expand = F.explode_outer if keep_empty else F.explode
    weight = F.coalesce("e.v", F.lit(0.0)) if keep_empty else F.col("e.v")
    return df.select(*keep, expand(pairs).alias("e")).select(
        *keep, F.col("e.i").alias("term_index"), weight.alias("weight")
    )
