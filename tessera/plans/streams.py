"""Streaming jobs over the provided tables: file sources -> stateful / stateless operators -> file sinks.

Inputs that Spark derives (fixtures) are first written as parquet under the session's checkpoint
folder, then consumed with ``readStream`` and ``trigger(availableNow=True)``; results are read back as
a batch DataFrame.  A job given a ``root`` of its own keeps output and checkpoint there, so started again it goes on
where it stopped; without one it gets a fresh folder under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir
from tessera.sources import schemas


def scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def run_available_now(spark: SparkSession, stream: DataFrame, name: str, foreach_batch=None, root: str | None = None) -> DataFrame:
    """Run over what has arrived and return all results so far.  Results of ``foreach_batch`` go to a folder per
    micro-batch that a retried batch overwrites, so none is written twice."""
    root = root or scratch(spark, name)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        w = w.foreachBatch(lambda df, batch: foreach_batch(df).write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    else:
        w = w.format("parquet").option("path", out).outputMode("append")
    q = w.start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.drop("batch") if foreach_batch is not None else rows


def stream_from(spark: SparkSession, df: DataFrame, name: str, files: int | None = None, key: str | None = None) -> DataFrame:
    """Materialise ``df`` as parquet files and open them as a streaming source (one file per trigger).  Without ``files`` their
    number follows the data; with ``key`` all rows of a key land in the same file (hence the same micro-batch)."""
    path = scratch(spark, f"{name}-src")
    cut = [files] if files else []
    (df.repartition(*cut, key) if key else df.repartition(files) if files else df).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def write_json_lines(conv: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """Conversations as JSON lines ``{"id", "conversations"}`` of text files, as they arrive from elsewhere."""
    conv.select(F.to_json(F.struct(F.col(key).alias("id"), "conversations")).alias("value")).write.mode(mode).text(path)


def sft_samples_stream(spark: SparkSession, lines: str, root: str | None = None, max_len: int = 1024, seed: int = 42,
                       files_per_trigger: int = 1) -> tuple[DataFrame, DataFrame]:
    """JSON-line files that arrive in ``lines`` become training rows ``(sample_id, input_ids, labels)``, and the lines that are
    no conversation become rejects ``(value, reason)``; returns both as they stand after this run.

    A micro-batch writes both outputs into folders named by its number, overwriting what a failed attempt left, so
    after a restart on the same ``root`` no line is lost or written twice.  A sample's draws hang on its ``id`` (on the line's
    digest where it has none), not on the micro-batch, so rows equal those of a batch job over the same files.
    """
    from tessera.plans.sft import sft_samples
    root = root or scratch(spark, "sft-samples")
    line = T.StructType([T.StructField("id", T.StringType()), *schemas.SFT.fields])

    def samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        parsed = df.withColumn("j", F.from_json("value", line, {"mode": "PERMISSIVE"}))
        whole = F.col("j.conversations").isNotNull() & (F.size("j.conversations") > 0) & ~F.exists("j.conversations", lambda m: m.isNull())
        conv = parsed.where(whole).select(F.coalesce("j.id", F.md5("value")).alias("sample_id"), "j.conversations")
        rows = sft_samples(conv, key="sample_id", max_len=max_len, seed=seed, with_tools=False).select("sample_id", "input_ids", "labels")
        reason = F.when(F.col("j.conversations").isNull(), "malformed").when(F.size("j.conversations") == 0, "empty").otherwise("null message")
        return rows, parsed.where(F.coalesce(~whole, F.lit(True))).select("value", reason.alias("reason"))

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for name, part in zip(("samples", "rejects"), samples(df)):
                part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        finally:
            df.unpersist()

    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(lines)
    query = source.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = "sample_id string, input_ids array<int>, labels array<int>"
    return (spark.read.schema(schema).parquet(f"{root}/samples").drop("batch"),
            spark.read.schema("value string, reason string").parquet(f"{root}/rejects").drop("batch"))
