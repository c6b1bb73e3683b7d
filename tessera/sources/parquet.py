"""Parquet and media-file scans (S7, S8, S9, S13) and ordered shard union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import schemas
from tessera.sources.tables import with_file_order


def conversations_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Long ``(conv_id, turn, role, text)`` -> one row per conversation in the SFT message shape.

    One hash aggregation on the key; a conversation's messages travel together (bounded by
    the conversation length, not by the table).
    """
    msg = F.struct(
        F.col("turn").alias("turn"),
        F.struct(
            F.col("role").alias("role"), F.col("text").alias("content"),
            F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast("string").alias("tools"),
            F.lit(None).cast("string").alias("tool_calls"),
        ).alias("m"),
    )
    return (turns.groupBy(key)
            .agg(F.array_sort(F.collect_list(msg)).alias("_msgs"))
            .select(key, F.col("_msgs.m").alias("conversations")))


def _as_list(c: F.Column, dtype: T.DataType) -> F.Column:
    return c if isinstance(dtype, T.ArrayType) else F.when(c.isNull(), F.array()).otherwise(F.array(c))


def scan_vision_parquet(spark: SparkSession, path: str, max_samples: int | None = None,
                        columns: list[str] | None = None) -> DataFrame:
    """Vision rows; ``conversations`` may be JSON text or a native list; a scalar image becomes a 1-list.

    Unlike the reference we read only the needed columns (``columns``).  ``max_samples`` keeps the
    first N rows in file order (an ordered limit).
    """
    df = with_file_order(spark.read.parquet(path), "sample_id")
    if columns:
        df = df.select(*columns, "sample_id")
    if max_samples is not None:
        df = df.filter(F.col("sample_id") < max_samples)
    fields = {f.name: f.dataType for f in df.schema.fields}
    if "conversations" in fields and isinstance(fields["conversations"], T.StringType):
        df = df.withColumn("conversations", F.from_json("conversations", schemas.VISION_CONVERSATION))
    if "image_bytes" in fields:
        df = df.withColumn("image_bytes", _as_list(F.col("image_bytes"), fields["image_bytes"]))
    return df


SPEECH_OPTIONAL = {
    "question_audios": T.ArrayType(T.BinaryType()),
    "answer_audios": T.ArrayType(T.ArrayType(T.IntegerType())),
    "image_bytes": T.ArrayType(T.BinaryType()),
    "ref_audios": T.ArrayType(T.IntegerType()),
    "spk_emb": T.ArrayType(T.FloatType()),
}


def scan_speech_parquet(spark: SparkSession, paths: str, max_samples: int | None = None) -> DataFrame:
    """Comma-separated shards unioned in order; optional columns default to ``[]``; first N rows."""
    shards, before = [], 0
    for p in filter(None, (p.strip() for p in paths.split(","))):
        shards.append(with_file_order(spark.read.parquet(p), "sample_id").withColumn("sample_id", F.col("sample_id") + before))
        before += spark.read.parquet(p).count()   # from the footers
    df = union_shards(shards)
    if max_samples is not None:
        df = df.filter(F.col("sample_id") < max_samples)
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name, dtype in SPEECH_OPTIONAL.items():
        if name not in fields:
            df = df.withColumn(name, F.array().cast(dtype))
        elif name == "image_bytes":
            df = df.withColumn(name, F.coalesce(_as_list(F.col(name), fields[name]), F.array().cast(dtype)))
        else:
            df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(dtype)))
    if isinstance(fields.get("conversations"), T.StringType):
        df = df.withColumn("conversations", F.from_json("conversations", schemas.CONVERSATION))
    return df


def union_shards(dfs: list[DataFrame]) -> DataFrame:
    """UNION ALL by name in the given order; duplicates kept; missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def scan_media_dir(spark: SparkSession, directory: str, prefix: str = "", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files of a directory by name prefix and case-insensitive suffix, sorted by name, with bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(directory)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = df.withColumn("name", name).filter(F.col("name").startswith(prefix))
    if suffixes:
        cond = reduce(lambda a, b: a | b, [F.lower("name").endswith(s.lower()) for s in suffixes])
        df = df.filter(cond)
    return df.select("name", "path", "length", "content").orderBy("name")
