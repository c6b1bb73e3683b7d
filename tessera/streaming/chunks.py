"""X5 count-window chunking with overlap, X6 session history (batch forms as plain Spark plans; ``keyed.py`` has the streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_chunks(frames: DataFrame, key: str = "session_id", size: int = 4, overlap: int = 2) -> DataFrame:
    """One row per emitted chunk ``(key, chunk_no, start_seq, end_seq, trim)`` over frames 0..n-1.

    At every multiple n=k*size the last ``size + min(overlap, n-size)`` frames are emitted and the first
    ``trim`` of them are overlap to cut; at the end the remainder (if any) is flushed the same way.
    Only the frame count per key is needed: one partial+final aggregation, then arithmetic.
    """
    n = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    full = F.floor(F.col("_n") / size)
    ks = n.select(key, "_n", F.explode(F.sequence(F.lit(1), full + 1)).alias("chunk_no"))
    end = F.when(F.col("chunk_no") <= full, F.col("chunk_no") * size).otherwise(F.col("_n"))
    length = F.when(F.col("chunk_no") <= full, F.lit(size)).otherwise(F.col("_n") - full * size)
    trim = F.least(F.lit(overlap), end - length)
    out = ks.withColumn("_end", end).withColumn("_len", length).filter(F.col("_len") > 0)
    return out.select(key, F.col("chunk_no").cast("int").alias("chunk_no"),
                      (F.col("_end") - F.col("_len") - trim).cast("long").alias("start_seq"),
                      (F.col("_end") - 1).cast("long").alias("end_seq"), trim.cast("int").alias("trim"))


def history_window(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """P12 / X6 batch: for each message, the number of history messages kept (the last n before it)
    and the first of them; n = 0 keeps none."""
    if n <= 0:
        return turns.withColumn("n_hist", F.lit(0).cast("long")).withColumn("hist_first", F.lit(None).cast("long"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return (turns.withColumn("n_hist", F.count(F.lit(1)).over(w).cast("long"))
            .withColumn("hist_first", F.min(order).over(w)))


def chunk_frames(frames: DataFrame, key: str = "session_id", seq: str = "seq", frame: str = "frame", size: int = 4, overlap: int = 2) -> DataFrame:
    """X5 with the frames themselves: each frame goes to its chunk and to those whose overlap it is, and chunks are put together."""
    chunks = overlap_chunks(frames, key, size, overlap)
    own = F.floor(F.col(seq) / size) + 1
    numbers = F.sequence(own, F.floor((F.col(seq) + overlap) / size) + 1)
    dealt = frames.select(key, seq, frame, F.explode(numbers.cast("array<int>")).alias("chunk_no"))
    whole = dealt.groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list(F.struct(seq, frame))).alias("_f"))
    return chunks.join(whole, [key, "chunk_no"]).select(*chunks.columns, F.transform("_f", lambda x: x[frame]).alias("frames"))


def history_messages(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """P12 / X6 with the messages themselves: each message and the ``n`` before it, 0 keeps none."""
    kept = F.array().cast("array<struct<role: string, text: string>>")
    if n > 0:
        kept = F.collect_list(F.struct("role", "text")).over(Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1))
    return turns.select(key, F.col(order).cast("long").alias("turn"), "role", "text", kept.alias("history"))
