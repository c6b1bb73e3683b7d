"""Sinks (S10, S11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tokens import ROLE_TOKENS


def write_training_table(df: DataFrame, path: str, mode: str = "errorifexists",
                         partition_by: list[str] | None = None) -> None:
    """Write sample rows as parquet.  Atomicity comes from Spark's job commit protocol
    (the reference's tmp-file + rename)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def role_map(vocab: DataFrame) -> DataFrame:
    """Special-role map (role, token, id): the fixed roles, and each special token but that of padding as
    ``additional_special_tokens``.  A role whose token the vocabulary lacks has a null id."""
    roles = vocab.sparkSession.createDataFrame(list(ROLE_TOKENS.items()), "role string, token string")
    known = vocab.select("token", "id").dropDuplicates(["token"])
    more = vocab.where(F.col("special") & (F.col("token") != ROLE_TOKENS["pad_token"])).select(
        F.lit("additional_special_tokens").alias("role"), "token", "id")
    return roles.join(known, "token", "left").select("role", "token", "id").unionByName(more)


def save_tokenizer(vocab: DataFrame, merges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vocabulary ``(id, token, special)``, ordered merges ``(rank, left, right)`` and the special-role map as
    one parquet table, written by one job, so a reader sees all three of one tokenizer or none.

    Beside it, for other tools, JSON lines of the merges in their order and of the roles."""
    parts = {"vocab": vocab, "merges": merges, "roles": role_map(vocab)}
    whole = None
    for part, rows in parts.items():
        held = rows.select(F.lit(part).alias("part"), F.struct(*rows.columns).alias(part))
        whole = held if whole is None else whole.unionByName(held, allowMissingColumns=True)
    whole.write.mode(mode).partitionBy("part").parquet(f"{path}/tokenizer")
    spark = vocab.sparkSession
    for part, order in (("merges", "rank"), ("roles", "role")):
        rows = _part(spark, path, part)
        rows.orderBy(order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(f"{path}/{part}_json")


def _part(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tokenizer").where(F.col("part") == part).select(f"{part}.*")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and merges."""
    return _part(spark, path, "vocab"), _part(spark, path, "merges")


def load_roles(spark: SparkSession, path: str) -> DataFrame:
    """Special-role map (role, token, id)."""
    return _part(spark, path, "roles")
