"""Queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and the oracles SQL can express.

Each query is thin: it reads its whole table, applies its operator and derives the columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (alignment, chat, decontam, dedup, exact_dedup, licenses, oracles, packing, periodic, quality, rans, token_counts,
                         toxicity, warc)
from tessera.llm.common import held_out
from tessera.sources.tables import read_table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files lie; the operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.tilings(docs, read_table(spark, sf_dir, "benchmark")).drop("tiles")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op6_chat")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(turns.unionByName(probe))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return packed.withColumn("length", F.col("length").cast("long"))


@query("op8_quality", oracles.QUALITY)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return rans.round_trip(docs, tokenizer_path("word_bpe_49k.json"))


@query("op10_warc", oracles.WARC)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return captures.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
                           F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
                           F.col("response.refers_to").alias("refers_to"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.with_planted_periods(docs))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.with_counts(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_exact_dedup", oracles.EXACT)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
