"""The registered queries of this subpackage, with the SQL that checks some of them (``ORACLES``)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.byte_bpe import encode_bytes
from corpusweave.llm.conversation_trie import prefix_trie
from corpusweave.llm.html_extract import extract_text
from corpusweave.llm.language_id import detect_language, fit_languages
from corpusweave.llm.mixing import mix_sources
from corpusweave.llm.oracles import ORACLES
from corpusweave.llm.periodic_runs import periodic_runs
from corpusweave.llm.quality_classifier import fit_quality, held_out, score_quality
from corpusweave.llm.quality_rules import quality_rules
from corpusweave.llm.simhash import simhash_groups
from corpusweave.llm.suffix_dedup import PASSAGE_WORDS, remove_repeats
from corpusweave.llm.token_counts import count_tokens
from corpusweave.llm.token_files import read_token_files, write_token_files
from corpusweave.llm.vector_search import exact_top_k
from corpusweave.session import scratch_path

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = quality_rules(table(spark, sf_dir, "documents"), trusted)
    return rows.drop("text", "lang", "source", "n_chars")


@query
def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, BPE_JSON)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bytes(table(spark, sf_dir, "documents"), BPE_RANKS, digest=True)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BPE_JSON)


@query
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True, passage_words=PASSAGE_WORDS)


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()), "quality")
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    shared = F.crc32(conv.cast("string")) % 4
    nodes = prefix_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, skip=shared)
    return nodes.drop("words")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about a tenth of the texts, told by a hash of the id, the words from some
    place on become repetitions of the first few words there. Their words are then joined by one space."""
    chosen = F.coalesce(F.col("_hash") % 10 == 0, F.lit(False))
    source = F.expr("transform(sequence(0, _n - 1), i -> get(_words, int(if(i < _from, i, _from + (i - _from) % _period))))")
    return (
        docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_hash"))
        .withColumn("_words", F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
        .withColumns({"_n": F.size("_words"), "_g": F.expr("_hash div 10")})
        .withColumn("_from", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
        .withColumn("_period", F.expr("1 + (_n - _from) div (3 + _g % 8)"))
        .select("doc_id", F.when(F.col("_n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))
    )


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")), digest=True)


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit_languages(docs.where(~held_out()))
    scored = detect_language(docs, network, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
