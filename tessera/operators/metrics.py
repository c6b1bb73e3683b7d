"""Run metrics: generation throughput (A14), streamed tool-call assembly (A18), step counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generation_throughput(events: DataFrame, request: str, ts: str, kind: str, text_kind: str,
                          audio_kind: str) -> DataFrame:
    """A14 per request: new tokens (events) per second of elapsed time, and first-text / first-audio
    latency in milliseconds rounded to 1 decimal (null when that kind never occurs)."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))  # whole microseconds, so that rounding is exact
    agg = events.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.min(t).alias("_t0"), F.max(t).alias("_t1"),
        F.min(F.when(F.col(kind) == text_kind, t)).alias("_tt"),
        F.min(F.when(F.col(kind) == audio_kind, t)).alias("_ta"))
    elapsed = F.col("_t1") - F.col("_t0")

    def ms(c):
        return F.round((F.col(c) - F.col("_t0")).cast("decimal(20,0)") / 1000, 1).cast("double")

    return agg.select(request, "n_tokens", F.when(elapsed > 0, F.col("n_tokens") / (elapsed / 1000000.0)).alias("tokens_per_s"),
                      ms("_tt").alias("first_text_ms"), ms("_ta").alias("first_audio_ms"))


def assemble_tool_deltas(chunks: DataFrame, request: str, seq: str, index: str, id: str, name: str, arguments: str) -> DataFrame:
    """Streamed fragments of tool calls put together in arrival order, one row per (request, call slot).

    A fragment with an index goes to that slot, and slots up to it come to be (empty where no fragment names them); one without
    opens the slot after the last.  With c nulls so far the number of slots is c + max(0, index + 1 - nulls before), a
    running count and a running maximum; ``seq`` orders a request's fragments.
    """
    from pyspark.sql import Window
    upto = Window.partitionBy(request).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(request).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    nulls = F.sum(F.col(index).isNull().cast("long"))
    c = chunks.withColumn("_nulls", nulls.over(upto)).withColumn("_free", F.col(index) + 1 - F.col("_nulls"))
    opened = F.col("_nulls") - 1 + F.greatest(F.lit(0), F.coalesce(F.max("_free").over(before), F.lit(0)))
    c = c.withColumn("call_index", F.coalesce(F.col(index), opened).cast("long"))
    joined = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, F.col(part).alias("x")))), lambda r: r["x"]), "")
    calls = c.groupBy(request, "call_index").agg(F.count(F.lit(1)).alias("n_fragments"), joined(id).alias("id"), joined(name).alias("name"),
                                                 joined(arguments).alias("arguments"))
    named = calls.groupBy(request).agg(F.collect_list("call_index").alias("_slots"))
    empty = named.select(request, F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.array_max("_slots")), "_slots")).alias("call_index"))
    blank = F.lit("")
    return calls.unionByName(empty.select(request, "call_index", F.lit(0).cast("long").alias("n_fragments"), blank.alias("id"),
                                          blank.alias("name"), blank.alias("arguments")))


def step_counts(df: DataFrame, by: list[str], batch_size: int, accum: int, epochs: int, skip: int = 0) -> DataFrame:
    """Batches per epoch ``ceil(n/bs) - skip`` and optimizer steps ``ceil(iters/accum) * epochs``."""
    n = F.count(F.lit(1))
    g = df.groupBy(*by).agg(n.alias("n"))
    iters = F.greatest(F.ceil(F.col("n") / batch_size) - skip, F.lit(0))
    return g.select(*by, F.col("n").cast("long").alias("n"), iters.cast("long").alias("iters"),
                    (F.ceil(iters / accum) * epochs).cast("long").alias("optimizer_steps"))
