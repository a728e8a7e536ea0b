"""Reading a corpus of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import contains_url
from corpusweave.operators.numbering import number_rows


def load_corpus(
    spark: SparkSession,
    path: str,
    *,
    file_format: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    name: str = "name",
    na_values: Sequence[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """``(doc_id, text[, name])`` from CSV or parquet; a missing text becomes ``""``.

    Quoted CSV fields may hold line breaks. Such a file is read by one task, so give a very large
    corpus as many files, as parquet, or without line breaks in fields and ``multi_line=False``.
    Rows without a ``doc_id`` column are numbered.
    """
    file_format = file_format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if file_format not in ("csv", "parquet"):
        raise ValueError("a corpus is read from csv or parquet")
    try:
        if file_format == "csv":
            table = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
        else:
            table = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"no corpus at {path}") from error
        raise
    if text not in table.columns:
        raise ValueError(f"the corpus needs a column {text!r}; it has {table.columns}")
    content = F.coalesce(F.col(text), F.lit(""))
    if na_values:
        content = F.when(content.isin(list(na_values)), F.lit("")).otherwise(content)
    columns = [content.alias("text")]
    if name in table.columns:
        columns.append(F.col(name).alias("name"))
    if key in table.columns:
        return table.select(F.col(key).cast("bigint").alias("doc_id"), *columns)
    return number_documents(table.select(*columns))


def number_documents(docs: DataFrame) -> DataFrame:
    """Add a ``doc_id`` that depends on the rows alone, not on how they are partitioned.

    Rows are ordered by a hash of their content. Equal rows are interchangeable, so among them any
    order will do, and a large group of copies may be spread over many tasks.
    """
    keyed = docs.select(
        "*",
        F.xxhash64(*docs.columns).alias("_hash"),
        F.xxhash64(F.lit(1), *docs.columns).alias("_hash2"),
        F.monotonically_increasing_id().alias("_copy"),
    )
    numbered = number_rows(keyed, ["_hash", "_hash2", "_copy"], "doc_id")
    return numbered.select("doc_id", *docs.columns)


def corpus_head(docs: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    return docs.orderBy(key).limit(n)


def corpus_profile(docs: DataFrame, text: str = "text", processed: str | None = None) -> DataFrame:
    """One row: documents, documents with processed text left, and text lengths."""
    left = F.col(processed or text)
    size = F.length(text)
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(left != "", F.lit(1))).alias("n_nonempty"),
        F.min(size).cast("bigint").alias("min_chars"),
        F.max(size).cast("bigint").alias("max_chars"),
        F.avg(size).alias("avg_chars"),
    )


def has_urls(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row telling whether any document holds a URL."""
    return docs.agg(F.coalesce(F.bool_or(contains_url(F.col(text))), F.lit(False)).alias("has_urls"))
