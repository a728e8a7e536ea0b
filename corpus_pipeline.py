"""Documents to training tokens: filter, de-duplicate, mix and encode, each stage a Spark job."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.byte_bpe import encode_bytes
from corpusweave.llm.mixing import repeat_to_weights
from corpusweave.llm.quality_rules import quality_rules
from corpusweave.llm.simhash import drop_near_duplicates
from corpusweave.llm.suffix_dedup import drop_repeats
from corpusweave.session import delete_scratch, scratch_path, scratch_scope


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted are those labelled as of good quality."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return quality_rules(rows, trusted).where("kept").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 4-word fingerprints that differ in 4 bits or fewer: the one with the smallest id."""
    return drop_near_duplicates(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more words that occur more than once; n_chars follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeat_to_weights(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and copy and their decoding, as counts and digests: doc_id, n_tokens,
    ids_sha256, decoded_sha256. A null text has no tokens."""
    return encode_bytes(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)


STAGES = [
    ("quality rules", filter_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]
ORACLE_SQL = None  # fingerprints, suffix arrays, tilts and merges have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's input.

    One row per kept document and copy: doc_id, n_tokens, ids_sha256, decoded_sha256. What a stage set
    down is deleted when its output is written, and that output when the next one is; the last stays.
    Each stage's operator says how it takes nulls, empty texts, ties and repeated rows; an empty table
    gives an empty result.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for place, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{place}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            delete_scratch(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
