"""SFT sample building: conversations -> rendered prompt -> token ids -> supervised labels.

One lazy plan: S9 (one hash aggregation on conv_id) -> P3 -> P7 -> P4 -> T6 -> Q2 -> Q4/Q5.
Everything after S9 is row-local (no further shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chat import add_system_prompt, extract_tools, strip_empty_think, with_rendered_chat
from tessera.operators.sequences import assistant_spans, pad_right, span_labels
from tessera.operators.tokenizer import encode_bytes, encode_bytes_native, encode_bytes_py
from tessera.sources.parquet import conversations_from_turns

ASSISTANT_START = "<|im_start|>assistant\n"
TURN_END = "<|im_end|>\n"


def merged_encoder(merges: DataFrame):
    """Column encoder of a trained vocabulary, for the ``encode`` argument of the jobs."""
    from tessera.operators.bpe import encode_bpe_column
    return lambda text: encode_bpe_column(text, merges)


def _marks(spark, encode) -> tuple[list[int], list[int]]:
    """Ids of the marks around an assistant turn."""
    if encode is encode_bytes:
        return encode_bytes_py(ASSISTANT_START).tolist(), encode_bytes_py(TURN_END).tolist()
    marks = spark.createDataFrame([(ASSISTANT_START, TURN_END)], "a string, b string")
    row = marks.select(encode("a").alias("a"), encode("b").alias("b")).first()
    return list(row.a), list(row.b)


def pretrain_samples(rows: DataFrame, key: str, text: str = "text", max_len: int = 512, encode=encode_bytes) -> DataFrame:
    """SURVEY §3 pretraining job as one plan: T6 -> Q1 -> Q2 -> Q3.  (key, input_ids, labels)."""
    from tessera.operators.sequences import mask_pad_labels, wrap_truncate
    ids = rows.where(F.col(text).isNotNull()).select(key, encode(text).alias("ids"))
    padded = ids.select(key, pad_right(wrap_truncate("ids", max_len), max_len).alias("input_ids"))
    return padded.withColumn("labels", mask_pad_labels("input_ids"))


def sft_samples(conv: DataFrame, key: str = "sample_id", max_len: int = 1024, seed: int = 42,
                with_tools: bool = True, system_ratio: float = 0.2, keep_empty_think: float = 0.2, encode=encode_bytes, prompts=None) -> DataFrame:
    """Rows ``(key, prompt, ids_full, input_ids, labels, spans)`` from a ``conversations`` column.  ``encode`` turns a text
    column into ids: the byte vocabulary, or ``merged_encoder(merges)``; ``prompts`` are the system prompts to draw from."""
    bos_seq, eos_seq = _marks(conv.sparkSession, encode)
    df = conv.withColumn("conversations", add_system_prompt(
        "conversations", key, system_ratio, seed, **({"prompts": tuple(prompts)} if prompts else {})))
    tools = extract_tools("conversations") if with_tools else None
    df = with_rendered_chat(df, "conversations", "prompt", tools=tools, tool_calls=with_tools)
    df = df.withColumn("prompt", strip_empty_think("prompt", key, keep_empty_think, seed))
    # With tool calls the prompt carries a Python UDF result nested under a higher-order function; a second
    # Python UDF on top of it is not extracted by Spark, so that path uses the (identical) native encoder.
    native = with_tools and encode is encode_bytes
    if with_tools and not native:   # ... and for other encoders the rendered prompts are written first
        from tessera.plans.streams import scratch
        path = scratch(conv.sparkSession, "prompts")
        df.write.parquet(path)
        df = conv.sparkSession.read.schema(df.schema).parquet(path)
    df = df.withColumn("ids_full", encode_bytes_native("prompt") if native else encode("prompt"))
    df = df.withColumn("input_ids", pad_right("ids_full", max_len))
    df = df.withColumn("spans", assistant_spans("input_ids", bos_seq, eos_seq))
    df = df.withColumn("labels", span_labels("input_ids", "spans", len(eos_seq), max_len))
    return df


def sft_report(turns: DataFrame, max_len: int = 1024, seed: int = 42) -> DataFrame:
    """The minimum end-to-end slice: per conversation (n_tokens, n_supervised, n_spans, truncated)."""
    conv = conversations_from_turns(turns, "conv_id")
    s = sft_samples(conv, key="conv_id", max_len=max_len, seed=seed, with_tools=False)
    return s.select(
        "conv_id",
        F.size("ids_full").cast("long").alias("n_tokens"),
        F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_supervised"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("ids_full") > max_len).cast("long").alias("truncated"),
    )


def preference_samples(pairs: DataFrame, keys: list[str], max_len: int = 1024, seed: int = 42, encode=encode_bytes) -> DataFrame:
    """Q9: (keys, x_chosen, y_chosen, mask_chosen, x_rejected, y_rejected, mask_rejected) of message lists ``chosen`` and
    ``rejected``; P4 draws once per side.  ``encode`` turns a text column into ids (default: the byte vocabulary)."""
    from tessera.functions.arrays import let
    from tessera.operators.chat import render_chat
    from tessera.operators.sequences import loss_mask, shift_xy
    bos, eos = _marks(pairs.sparkSession, encode)

    def arrays(ids):
        # the ids are bound: where Spark inlines them into the lambdas of the span search they would be padded anew for each position
        x, y = shift_xy(ids)
        mask = let(loss_mask(ids, assistant_spans(ids, bos, eos), len(eos), max_len), lambda m: shift_xy(m)[1])
        return F.struct(x.alias("x"), y.alias("y"), mask.alias("mask"))

    out = pairs.withColumn("_key", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    for side in ("chosen", "rejected"):
        out = out.withColumn("_prompt", strip_empty_think(render_chat(side), "_key", 0.2, seed, tag=f"think_{side}"))
        out = out.withColumn(f"_{side}", let(pad_right(encode("_prompt"), max_len), arrays))
    return out.select(*keys, *[F.col(f"_{side}.{a}").alias(f"{a}_{side}") for side in ("chosen", "rejected") for a in ("x", "y", "mask")])


def build_sft_dataset(spark, jsonl_path: str, out_path: str | None = None, max_len: int = 1024,
                      batch_size: int = 16, epoch: int = 0, skip_batches: int = 0, seed: int = 42,
                      mode: str = "errorifexists"):
    """SURVEY §3.1 as one lazy plan: S2 -> P3 -> P7 -> P4 -> T6 -> Q2 -> Q4/Q5 -> L1 -> L3 -> S10.

    Rows ``(sample_id, epoch, pos, batch_id, input_ids, labels)``; the epoch goes into the shuffle seed,
    the per-row random draws stay keyed by ``sample_id`` (so the samples are identical across epochs, only
    their order changes).  Written as parquet when ``out_path`` is given.
    """
    from tessera.operators.ordering import assign_batches, epoch_shuffle
    from tessera.sources.jsonl import scan_sft_jsonl

    conv = scan_sft_jsonl(spark, jsonl_path)
    s = sft_samples(conv, key="sample_id", max_len=max_len, seed=seed, with_tools=True)
    s = s.select("sample_id", "input_ids", "labels")
    ordered = epoch_shuffle(s, "sample_id", epoch, seed)
    batched = assign_batches(ordered, batch_size, skip_batches)
    out = batched.select("sample_id", "epoch", "pos", "batch_id", "input_ids", "labels")
    if out_path:
        out.write.mode(mode).parquet(out_path)
    return out
