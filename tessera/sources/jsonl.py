"""JSONL corpus scans (S1-S6).  Every scan declares its schema and adds ``sample_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import schemas
from tessera.sources.tables import with_file_order


def _read(spark: SparkSession, path: str, schema, mode: str = "FAILFAST") -> DataFrame:
    return with_file_order(spark.read.schema(schema).option("mode", mode).json(path), "sample_id")


def scan_pretrain_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One ``text`` per line.  The reference's ``str()`` turns a null into "None"; we drop nulls."""
    return _read(spark, path, schemas.PRETRAIN).filter(F.col("text").isNotNull())


def scan_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Fixed five-string-field message schema; a malformed line fails the job."""
    return _read(spark, path, schemas.SFT)


def scan_preference_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``chosen`` / ``rejected`` message lists; a malformed line fails the job."""
    return _read(spark, path, schemas.PREFERENCE)


def scan_rlaif_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``conversations`` only; a malformed line fails the job."""
    return _read(spark, path, schemas.RLAIF)


def scan_agent_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Conversations and ground truth; a malformed line fails the job."""
    return _read(spark, path, schemas.AGENT)


def without_undecodable(text: Column) -> Column:
    """Bytes that are no UTF-8 are dropped; replacement characters that stand in the data stay."""
    real, spare = F.lit("\ufffd"), F.lit("\U0010fffe")
    kept = F.replace(F.make_valid_utf8(F.replace(text, real, spare)), real, F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(kept, spare, real))


def scan_tokenizer_corpus(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """The tokenizer-training text stream of the whole corpus, or of its first ``max_lines`` lines in file order.

    A line cap counts every physical line, malformed ones included; malformed JSON is
    skipped; the non-empty ``content`` values of a line are joined by newlines; lines
    with none are skipped.
    """
    lines = with_file_order(spark.read.text(path), "line_no")
    if max_lines is not None:
        lines = lines.filter(F.col("line_no") < max_lines)
    parsed = lines.select("line_no", F.from_json(without_undecodable(F.col("value")), schemas.SFT).alias("j"))
    contents = F.filter(F.col("j.conversations.content"), lambda c: c.isNotNull() & (F.length(c) > 0))
    return (parsed.filter(F.col("j").isNotNull())
            .select("line_no", contents.alias("contents"))
            .filter(F.size("contents") > 0)
            .select("line_no", F.array_join("contents", "\n").alias("text")))
