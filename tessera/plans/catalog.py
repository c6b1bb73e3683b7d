"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB oracle SQL.

Every query reads the provided tables (or fixtures Spark derives from them) in full.
Results are flat scalar columns; doubles are rounded to 6 places in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import oracles
from tessera.plans.sft import sft_report
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("sft_report", oracles.sft_report_sql())
def q_sft_report(spark, sf):
    return sft_report(read_table(spark, sf, "conversations"))


# ---- rollout scoring and advantages -------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import advantages as adv  # noqa: E402
from tessera.plans import fixtures as fx  # noqa: E402
from tessera.plans import rl  # noqa: E402


def _label_scores(spark, sf):
    lab = read_table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("prompt_id"),
                      (F.col("quality").cast("double") - 5.0 * F.col("toxic")).alias("score"))


@register("agent_rewards", oracles.agent_rewards_sql())
def q_agent_rewards(spark, sf):
    return rl.agent_rewards(fx.rollouts(spark, sf), fx.tasks(spark, sf))


@register("chat_rewards", oracles.chat_rewards_sql())
def q_chat_rewards(spark, sf):
    df = rl.chat_rewards(fx.rollouts(spark, sf), _label_scores(spark, sf))
    return df.select("prompt_id", "gen_id", rl.r6("reward").alias("reward"), rl.r6("advantage").alias("advantage"))


@register("gae_whiten", oracles.gae_whiten_sql())
def q_gae_whiten(spark, sf):
    return rl.gae_whiten(fx.token_logps(spark, sf))


@register("policy_diagnostics", oracles.policy_diagnostics_sql())
def q_policy_diagnostics(spark, sf):
    d = adv.policy_diagnostics(fx.token_logps(spark, sf), ["prompt_id"])
    return d.select("prompt_id", *[rl.r6(c).alias(c) for c in ("mean_ratio", "kl_ref", "approx_kl", "clip_frac")],
                    F.col("n_tokens").cast("long").alias("n_tokens"))


@register("masked_loss", oracles.masked_loss_sql())
def q_masked_loss(spark, sf):
    t = fx.token_logps(spark, sf).withColumn("loss", -F.col("lp_new"))
    d = adv.masked_loss(t, ["prompt_id"], ["gen_id"])
    return d.select("prompt_id", *[rl.r6(c).alias(c) for c in
                                   ("seq_mean", "seq_mean_nonempty", "token_mean", "token_mean_eps")])


@register("policy_loss", oracles.policy_loss_sql())
def q_policy_loss(spark, sf):
    return rl.policy_losses(fx.token_logps(spark, sf))


@register("gae_prefix_mask", oracles.gae_whiten_sql(tokens=oracles.PREFIX_TOKENS_CTE))
def q_gae_prefix_mask(spark, sf):
    """W2 / A17 with response masks that are prefixes, empty ones among them."""
    return rl.gae_whiten(fx.prefix_masked(fx.token_logps(spark, sf)))


@register("masked_loss_prefix", oracles.masked_loss_sql(oracles.PREFIX_TOKENS_CTE))
def q_masked_loss_prefix(spark, sf):
    """A9 by sequence, so that a group without any valid token occurs."""
    t = fx.prefix_masked(fx.token_logps(spark, sf)).withColumn("loss", -F.col("lp_new")).withColumn("prompt_id", F.col("gen_id"))
    d = adv.masked_loss(t, ["prompt_id"], ["gen_id"])
    return d.select("prompt_id", *[rl.r6(c).alias(c) for c in ("seq_mean", "seq_mean_nonempty", "token_mean", "token_mean_eps")])


@register("ppo_objective", oracles.ppo_objective_sql())
def q_ppo_objective(spark, sf):
    """A12 value loss and A13 PPO with the KL term, per prompt, over all valid tokens."""
    t = fx.prefix_masked(fx.token_logps(spark, sf)).withColumns({
        "advantage": F.col("v") - 0.5, "value": -F.col("lp_new") / 2, "old_value": F.col("v"), "ret": -F.col("lp_old") / 2})
    return adv.ppo_objective(t, ["prompt_id"]).select("prompt_id", rl.r6("policy_loss").alias("policy_loss"), rl.r6("value_loss").alias("value_loss"))


@register("token_kl", oracles.token_kl_sql())
def q_token_kl(spark, sf):
    """Token-weighted KL per prompt."""
    t = fx.prefix_masked(fx.token_logps(spark, sf))
    return adv.token_kl(t, ["prompt_id"]).select("prompt_id", rl.r6("kl").alias("kl"))


@register("preference_loss_tokens", oracles.preference_loss_tokens_sql())
def q_preference_loss_tokens(spark, sf):
    """A11 from masked per-token log-probabilities: sequences gen and gen + 40 of a prompt are a pair."""
    t = fx.prefix_masked(fx.token_logps(spark, sf)).withColumns({
        "pair": F.expr("gen_id div 80"), "chosen": F.expr("gen_id div 40 % 2 = 0")})
    p = adv.masked_logp_sums(t, ["prompt_id", "pair"]).where("pc is not null and pr is not null")
    out = adv.preference_loss(p)
    return out.select("prompt_id", "pair", rl.r6("margin").alias("margin"), rl.r6("loss").alias("loss"))


@register("agent_rewards_turns", oracles.agent_rewards_sql(turns=True))
def q_agent_rewards_turns(spark, sf):
    """A3 / A6 over all turns of a rollout."""
    return rl.agent_rewards(fx.episodes(spark, sf), fx.tasks(spark, sf), turns="turn_outputs")


@register("tool_calls_api", oracles.tool_calls_api_sql())
def q_tool_calls_api(spark, sf):
    """P16 (ii) and (iii): calls with ids, and the texts without their calls."""
    from tessera.operators import rewards as rw
    r = fx.rollouts(spark, sf)
    ids = F.transform(rw.extract_tool_calls_api("completion"), lambda c: F.concat_ws("|", c["id"], c["name"]))
    return r.select("prompt_id", "gen_id", F.coalesce(F.array_join(ids, ","), F.lit("none")).alias("calls"),
                    F.md5(rw.without_tool_calls("completion")).alias("text_md5"))


# ---- tokenizer statistics, ordering ----------------------------------------------------------

from tessera.operators import ordering as od  # noqa: E402
from tessera.operators import tokenizer as tk  # noqa: E402
from tessera.sources.tables import spread  # noqa: E402


@register("doc_token_stats", oracles.doc_token_stats_sql())
def q_doc_token_stats(spark, sf, max_len=1024, reserve=100):
    """T6 (byte vocabulary) + T9 + T10 over all documents, per language."""
    d = spread(read_table(spark, sf, "documents").select("lang", "text"))
    d = d.withColumn("n", tk.byte_token_count("text"))
    both = tk.token_length_stats(d, "n", ["lang"], max_len, reserve).join(tk.compression_ratio(d, "text", "n", ["lang"]), "lang")
    return both.select("lang", *[F.col(c).cast("long").alias(c) for c in ("n_rows", "n_tokens", "max_tokens")],
                       *[rl.r6(c).alias(c) for c in ("quantile_tokens", "chars_per_token", "truncated_share")])


@register("word_counts_ws", oracles.word_counts_ws_sql())
def q_word_counts_ws(spark, sf):
    """T4 on a plain whitespace split (SQL-checkable form)."""
    from tessera.functions.text import PY_SPACE_CLASS
    cls = "[" + PY_SPACE_CLASS + "]+"
    d = spread(read_table(spark, sf, "documents").select("text")).select(F.explode(F.split("text", cls)).alias("word"))
    return d.filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("word_counts", oracles.word_counts_sql())
def q_word_counts(spark, sf):
    """T4 with the byte-level pre-tokenizer."""
    d = spread(read_table(spark, sf, "documents").select("text"))
    return tk.word_counts(d, "text").withColumn("n", F.col("n").cast("long"))


@register("epoch_batches", oracles.epoch_batches_sql())
def q_epoch_batches(spark, sf, epochs=(0, 1), world=4, batch_size=8, skip0=1):
    """L1 seeded permutation per epoch -> L2 rank shards (wrap padding) -> L3 batches with a resume skip."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    out = None
    for e in epochs:
        p = od.epoch_shuffle(docs, "doc_id", e)
        s = od.shard_by_rank(p, world)
        b = od.assign_batches(s, batch_size, skip0 if e == epochs[0] else 0, pos="local_pos", size="shard_size")
        b = b.select(F.col("epoch").cast("int").alias("epoch"), "doc_id", F.col("pos").cast("long").alias("pos"),
                     "shard", "local_pos", "batch_id")
        out = b if out is None else out.unionByName(b)
    return out


# ---- streaming operators ----------------------------------------------------------------------

from tessera.plans import streams  # noqa: E402
from tessera.plans.sft import sft_report as _sft_report  # noqa: E402
from tessera.streaming import chunks as xc  # noqa: E402
from tessera.streaming import segments as xs  # noqa: E402
from tessera.streaming import text as xt  # noqa: E402

# fixture thresholds (FIXTURES.md: the defaults would never end a segment on this data)
SEG_ARGS = dict(thr=0.5, min_speech=1024, min_silence=1024)


@register("speech_segments", oracles.speech_events_sql(False))
def q_speech_segments(spark, sf):
    """X1 batch form over the audio-chunk fixture."""
    return xs.speech_segments(fx.audio_chunks(spark, sf), **SEG_ARGS)


@register("speech_interrupts", oracles.speech_events_sql(True))
def q_speech_interrupts(spark, sf):
    """Segments plus an interrupt when speech starts while a reply is being generated."""
    return xs.speech_segments(fx.audio_chunks(spark, sf), generating="generating", **SEG_ARGS)


@register("speech_segments_stream", oracles.speech_events_sql(False))
def q_speech_segments_stream(spark, sf):
    """X1 as a Structured Streaming job with keyed state; must equal the batch form."""
    src = streams.stream_from(spark, fx.audio_chunks(spark, sf), "chunks")
    return streams.run_available_now(spark, xs.speech_segments_stream(src, **SEG_ARGS), "segments")


@register("stream_sft_report", oracles.sft_report_sql())
def q_stream_sft_report(spark, sf):
    """The SFT slice over conversation files arriving as a stream (stateless per micro-batch; a
    conversation is assumed not to span files)."""
    turns = read_table(spark, sf, "conversations")
    src = streams.stream_from(spark, turns, "turns", key="conv_id")
    return streams.run_available_now(spark, src, "sft", foreach_batch=_sft_report)


@register("overlap_chunks", oracles.overlap_chunks_sql())
def q_overlap_chunks(spark, sf):
    """X5 count windows (size 4, overlap 2) over each session's windows."""
    return xc.overlap_chunks(fx.audio_chunks(spark, sf), "session_id", 4, 2)


@register("history_window", oracles.history_window_sql())
def q_history_window(spark, sf):
    """The last 4 messages before each user message."""
    t = read_table(spark, sf, "conversations")
    h = xc.history_window(t, 4)
    return h.filter(F.col("role") == "user").select("conv_id", "turn", "n_hist",
                                                    F.coalesce("hist_first", F.lit(-1)).alias("hist_first"))


@register("incremental_text", oracles.incremental_text_sql())
def q_incremental_text(spark, sf):
    """Stream-decode every conversation turn's byte tokens; pieces re-assemble the text."""
    t = spread(read_table(spark, sf, "conversations"))
    ids = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
                   F.posexplode(tk.encode_bytes("text")).alias("pos", "token_id"))
    p = xt.incremental_text(ids)
    agg = p.groupBy("request_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_pieces"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))),
                                       lambda x: x["text"]), "")).alias("text_md5"))
    return agg


# ---- keyed-state streams ---------------------------------------------------------------------------

from tessera.sources.parquet import conversations_from_turns as _conversations  # noqa: E402
from tessera.streaming import keyed as xk  # noqa: E402


@register("speech_segments_lossy", oracles.speech_events_sql(True, lossy=True))
def q_speech_segments_lossy(spark, sf):
    """X1 / X2 over a feed that loses windows: state timers pass over the gaps.  A last window of another session, two days on,
    moves the watermark past all that is waited for."""
    chunks = fx.lossy_chunks(spark, sf)
    end = spark.range(1).select(F.lit(-1).cast(chunks.schema["session_id"].dataType).alias("session_id"), F.lit(0).alias("seq"), F.lit(0.0).alias("prob"),
                                F.lit(False).alias("generating"), F.timestamp_millis(F.lit(fx.EPOCH_MS + 2 * 86_400_000)).alias("at"))
    feed = streams.scratch(spark, "lossy-src")
    chunks.write.parquet(feed)
    end.write.mode("append").parquet(feed)  # later than all others, as the source goes by the files' times
    src = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    return streams.run_available_now(spark, xs.speech_segments_stream(src, generating="generating", at="at", late="1 day", **SEG_ARGS), "lossy-segments")


@register("incremental_text_stream", oracles.incremental_text_sql())
def q_incremental_text_stream(spark, sf):
    """X3 with the pending bytes in keyed state, over tokens that arrive in any order."""
    t = read_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), tk.encode_bytes("text").alias("ids"))
    ids = t.select("request_id", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "token_id"))
    ids = ids.select("request_id", "pos", "token_id", (F.col("pos") == F.col("n") - 1).alias("last"))
    src = streams.stream_from(spark, ids, "tokens")
    p = streams.run_available_now(spark, xk.stream_of(src, xk.Decode, "request_id", "pos", ["token_id"], "last"), "pieces")
    return p.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda x: x["text"]), "")).alias("text_md5"))


@register("delta_split", oracles.delta_split_sql())
def q_delta_split(spark, sf):
    """Streamed replies split into reasoning, content, tool calls and the end."""
    return xt.split_deltas(fx.reply_deltas(spark, sf).drop("last"))


@register("delta_split_stream", oracles.delta_split_sql())
def q_delta_split_stream(spark, sf):
    """X4 with a resumable tag search in keyed state."""
    src = streams.stream_from(spark, fx.reply_deltas(spark, sf), "deltas")
    return streams.run_available_now(spark, xk.stream_of(src, xk.SplitDelta, "request_id", "seq", ["delta"], "last").toDF(
        "request_id", "seq", "kind", "text"), "delta-parts")


def _chunk_digests(chunks):
    return chunks.select("session_id", "chunk_no", "start_seq", "end_seq", "trim", F.md5(F.array_join("frames", ",")).alias("frames_md5"))


@register("chunk_frames", oracles.chunk_frames_sql())
def q_chunk_frames(spark, sf):
    """X5 with the frames themselves (size 4, overlap 2)."""
    return _chunk_digests(xc.chunk_frames(fx.session_frames(spark, sf).drop("last")))


@register("chunk_frames_stream", oracles.chunk_frames_sql())
def q_chunk_frames_stream(spark, sf):
    """X5 with the tail of the frames in keyed state and a flush at the session's end."""
    src = streams.stream_from(spark, fx.session_frames(spark, sf), "frames")
    return _chunk_digests(streams.run_available_now(spark, xk.stream_of(src, xk.overlapping(4, 2), "session_id", "seq", ["frame"], "last"), "chunks"))


def _history_digests(rows):
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n_hist"), F.md5(said).alias("history_md5"))


@register("history_messages", oracles.history_messages_sql())
def q_history_messages(spark, sf):
    """The last 4 messages before each message, whole."""
    return _history_digests(xc.history_messages(fx.ordered_messages(spark, sf), 4, order="seq"))


@register("history_messages_stream", oracles.history_messages_sql())
def q_history_messages_stream(spark, sf):
    """P12 / X6 with the kept messages in keyed state."""
    src = streams.stream_from(spark, fx.ordered_messages(spark, sf), "messages")
    return _history_digests(streams.run_available_now(spark, xk.stream_of(src, xk.history(4), "conv_id", "seq", ["role", "text"], "last"), "history"))


@register("stream_sft_samples", oracles.stream_sft_samples_sql())
def q_stream_sft_samples(spark, sf):
    """JSON-line files arriving as a stream, with lines that are none, become training rows."""
    lines = streams.scratch(spark, "sft-lines")
    conv = _conversations(read_table(spark, sf, "conversations"), "conv_id")
    streams.write_json_lines(conv, "conv_id", lines)
    conv.where("conv_id % 10 = 0").select(F.format_string('{"id": "%d", "conversations": [{"role"', "conv_id").alias("value")).write.mode("append").text(lines)
    samples, rejects = streams.sft_samples_stream(spark, lines)
    real = F.filter("input_ids", lambda x: x != 0)
    rows = samples.select(F.col("sample_id").cast("long").alias("conv_id"), F.lit("sample").alias("kind"), F.size(real).cast("long").alias("n_real"),
                          F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_supervised"))
    bad = rejects.select(F.regexp_extract("value", r'"id": "(\d+)"', 1).cast("long").alias("conv_id"), F.col("reason").alias("kind"))
    zero = F.lit(0).cast("long")
    return rows.unionByName(bad.select("conv_id", "kind", zero.alias("n_real"), zero.alias("n_supervised")))


# ---- chat shaping, tool calls, media placeholders -----------------------------------------------

from tessera.operators import audio as au  # noqa: E402
from tessera.operators import chat as ch  # noqa: E402
from tessera.operators import lookups as lk  # noqa: E402
from tessera.operators import metrics as mt  # noqa: E402
from tessera.operators import rewards as rw  # noqa: E402
from tessera.operators import sequences as sq  # noqa: E402
from tessera.sources.parquet import conversations_from_turns  # noqa: E402


def _calls(spark, sf):
    r = fx.rollouts(spark, sf)
    return r.select("prompt_id", "gen_id", F.explode(rw.extract_tool_calls("completion")).alias("c")) \
        .select("prompt_id", "gen_id", "c.*")


@register("tool_calls", oracles.tool_calls_sql())
def q_tool_calls(spark, sf):
    """Every parsable <tool_call> body of every completion."""
    return _calls(spark, sf).select("prompt_id", "gen_id", F.col("idx").cast("int").alias("idx"), "name", "arguments")


@register("exchange_lookup", oracles.exchange_lookup_sql())
def q_exchange_lookup(spark, sf):
    """P17 + J1: exchange-rate tool calls resolved against the rate dimension (default 1.0)."""
    c = _calls(spark, sf).filter(F.col("name") == "get_exchange_rate")
    a = rw.parse_tool_arguments("arguments")
    c = c.select("prompt_id", "gen_id", F.col("idx").cast("int").alias("idx"),
                 a["from_currency"].alias("from_currency"), a["to_currency"].alias("to_currency"))
    return lk.exchange_rate(c, fx.rates(spark, sf)).select("prompt_id", "gen_id", "idx", "from_currency", "to_currency", "rate")


@register("chat_parse", oracles.chat_parse_sql())
def q_chat_parse(spark, sf, seed=42):
    """P7 (generation prompt) -> P13 parse -> P14 reward context; P5 prompt size; P6 thinking draw."""
    conv = conversations_from_turns(read_table(spark, sf, "conversations"))
    d = ch.with_rendered_chat(conv, "conversations", "prompt", add_generation_prompt=True, tool_calls=False)
    d = d.withColumn("msgs", rw.parse_chatml("prompt")).withColumn("ctx", rw.reward_context("msgs"))
    return d.select("conv_id", F.size("msgs").cast("long").alias("n_msgs"),
                    F.length("ctx").cast("long").alias("ctx_len"), F.md5("ctx").alias("ctx_md5"),
                    F.size(ch.drop_last_turn("conversations")).cast("long").alias("n_prompt_msgs"),
                    ch.assign_thinking("conv_id", 0.5, seed).cast("int").alias("thinking"))


@register("image_runs", oracles.image_runs_sql())
def q_image_runs(spark, sf):
    """P8 expand <image> to 64 pads -> P7 -> T6 -> Q17 gaps-and-islands runs of the pad id."""
    conv = conversations_from_turns(fx.image_tagged_turns(spark, sf))
    conv = conv.withColumn("conversations", ch.expand_image_placeholder("conversations"))
    d = ch.with_rendered_chat(conv, "conversations", "prompt", tool_calls=False)
    toks = d.select("conv_id", F.posexplode(tk.encode_bytes("prompt")).alias("pos", "token_id"))
    runs = sq.placeholder_runs(toks, "conv_id")
    return runs.groupBy("conv_id").agg(F.count(F.lit(1)).cast("long").alias("n_runs"),
                                       F.sum("length").cast("long").alias("n_pad_tokens"))


@register("image_tags", oracles.image_tags_sql())
def q_image_tags(spark, sf):
    """Every turn; the image tag of those that have one is placed anew."""
    t = fx.image_tagged_turns(spark, sf)
    key = F.col("conv_id") * 1000 + F.col("turn")
    return t.select("conv_id", "turn", F.md5(ch.place_image_tag("text", key)).alias("tagged_md5"))


# ---- selection and audio -----------------------------------------------------------------------

@register("top_k", oracles.top_k_sql(2))
def q_top_k(spark, sf):
    """Per order, line items with the top-2 scores (ties kept), salted two-step ranking."""
    t = adv.top_k(fx.scored_candidates(spark, sf), k=2)
    return t.select("grp", "item", "score", F.col("rank").cast("int").alias("rank"))


@register("cumulative_mass", oracles.cumulative_mass_sql(0.6))
def q_cumulative_mass(spark, sf):
    """Nucleus selection at p=0.6 over each order's softmax of scores."""
    t = adv.cumulative_mass(fx.scored_candidates(spark, sf), 0.6)
    return t.select("grp", "item", rl.r6("prob").alias("prob"), rl.r6("mass_before").alias("mass_before"))


@register("audio_roundtrip", oracles.audio_roundtrip_sql())
def q_audio_roundtrip(spark, sf):
    """Q18 layers -> Q19 delay pattern -> Q20 undelay: recovers every frame of every code sequence."""
    codes = fx.audio_codes(spark, sf)
    seqs = codes.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_s"))
    layers = seqs.select("vec_id", au.audio_code_layers(F.col("_s.code")).alias("layers"))
    delayed = au.delay_pattern_long(layers, "vec_id", 0, max_len=32).withColumn("start", F.lit(0))
    frames = au.undelay_frames(delayed, "vec_id")
    return frames.select("vec_id", F.col("frame").cast("int").alias("frame"),
                         F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def _joined(arrays) -> "F.Column":
    return F.md5(F.array_join(F.transform(F.flatten(arrays), lambda c: c.cast("string")), ","))


@register("last_answer_labels", oracles.last_answer_labels_sql())
def q_last_answer_labels(spark, sf):
    """Q7: of a conversation's answers only the last is supervised."""
    from tessera.operators.tokenizer import encode_bytes_py
    from tessera.plans import sft
    conv = _conversations(read_table(spark, sf, "conversations"), "conv_id")
    s = sft.sft_samples(conv, key="conv_id", with_tools=False)
    labels = sq.span_labels("input_ids", "spans", len(encode_bytes_py(sft.TURN_END)), 1024, keep_last_only=True)
    return s.select("conv_id", F.size(F.filter(labels, lambda x: x != -100)).cast("long").alias("n_supervised"))


@register("speech_rows", oracles.speech_rows_sql())
def q_speech_rows(spark, sf, max_len=48):
    """Q18 -> Q21 draw and placement -> Q19 overlay -> shift -> Q23 sampling (p = 0.3): eight rows of inputs and labels."""
    seqs = fx.audio_codes(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_s"))
    k = F.col("vec_id")
    s = seqs.select("vec_id", F.when(k % 11 != 0, au.audio_code_layers(F.col("_s.code"))).alias("answer"),
                    F.when(k % 3 != 0, F.transform(F.slice("_s.code", 1, 45), lambda c: (c + 1) % 2048)).alias("ref"),
                    (4 + k % 7).cast("int").alias("start"), (k % 2 == 0).alias("spk"))
    rows = s.select("vec_id", au.speech_rows("answer", F.col("start"), max_len, "ref", F.col("spk"), au.reference_draw("vec_id")).alias("rows"))
    x, y = au.shifted_rows("rows")
    d = rows.select("vec_id", x.alias("x"), y.alias("y"))
    d = d.withColumn("z", sq.scheduled_sampling_audio("x", "y", "vec_id", p=0.3))
    return d.select("vec_id", _joined("x").alias("input_md5"), _joined("y").alias("labels_md5"), _joined("z").alias("sampled_md5"))


@register("rollout_assembly", oracles.rollout_assembly_sql())
def q_rollout_assembly(spark, sf):
    """Q26 with Q14: observations as what re-rendered contexts add to the known length."""
    r = sq.assemble_rollout(fx.rollout_turns(spark, sf), "conv_id")
    text = lambda c, scale=1: F.md5(F.array_join(F.transform(c, lambda x: F.round(x * scale).cast("int").cast("string")), ","))
    return r.select("conv_id", F.size("prompt_ids").cast("long").alias("n_prompt"), F.size("ids").cast("long").alias("n_ids"), text("ids").alias("ids_md5"),
                    text("mask").alias("mask_md5"), text("logps", 100).alias("logps_md5"), "unfinished")


@register("audio_quality", oracles.audio_quality_sql())
def q_audio_quality(spark, sf):
    """A15 with the fixture's short-clip settings (frame 80, hop 40, minimum 1000 samples)."""
    q = au.audio_quality(fx.waveforms(spark, sf), frame=80, hop=40, min_samples=1000)
    return q.select("clip_id", F.col("n_samples").cast("long").alias("n_samples"), rl.r6("q95").alias("q95"),
                    rl.r6("q20").alias("q20"), rl.r6("peak").alias("peak"), "verdict")


@register("center_features", oracles.center_features_sql())
def q_center_features(spark, sf):
    """Per (label, dimension) mean-centred log magnitudes of the embeddings."""
    e = read_table(spark, sf, "embeddings")
    f = e.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")) \
        .withColumn("value", F.abs(F.col("x").cast("double")))
    c = adv.center_features(f, ["label", "dim"], "value")
    return c.select("vec_id", F.col("dim").cast("int").alias("dim"), rl.r6("centered").alias("centered"))


# ---- run metrics ---------------------------------------------------------------------------------

@register("generation_throughput", oracles.generation_throughput_sql())
def q_generation_throughput(spark, sf):
    """A14 per user: events as generated tokens, 'view' as first text, 'click' as first audio."""
    g = mt.generation_throughput(read_table(spark, sf, "events"), "user_id", "ts", "event_type", "view", "click")
    return g.withColumn("tokens_per_s", rl.r6("tokens_per_s"))


@register("tool_deltas", oracles.tool_deltas_sql())
def q_tool_deltas(spark, sf):
    """Fragments assembled per (user, call slot); some carry no index, id, name or arguments."""
    k = F.col("event_id")
    e = read_table(spark, sf, "events").select(
        "user_id", "event_id", F.when((k % 5 == 0) | (k % 7 == 1), F.lit(None)).otherwise(k % 4).alias("idx"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), k % 10)).alias("id"), F.when(k % 4 == 1, F.substring("event_type", 1, 2)).alias("name"),
        F.when(k % 11 != 0, F.col("event_type")).alias("args"))
    a = mt.assemble_tool_deltas(e, "user_id", "event_id", "idx", "id", "name", "args")
    return a.select("user_id", "call_index", "n_fragments", "id", "name", F.md5("arguments").alias("args_md5"))


@register("reward_report", oracles.reward_report_sql())
def q_reward_report(spark, sf):
    """A8 over the chat rewards: mean reward, mean group std, advantage mean / sample std, mean length."""
    r = fx.rollouts(spark, sf)
    c = rl.chat_rewards(r, _label_scores(spark, sf)).withColumn("len", F.length("completion"))
    c = c.withColumn("reward", rl.r6("reward")).withColumn("advantage", rl.r6("advantage"))
    rep = adv.reward_report(c, [], "prompt_id", "reward", "advantage", "len")
    return rep.select(*[rl.r6(x).alias(x) for x in ("mean_reward", "adv_mean", "adv_std")],
                      F.col("n").cast("long").alias("n"), rl.r6("mean_length").alias("mean_length"),
                      rl.r6("mean_group_std").alias("mean_group_std"))


@register("preference_loss", oracles.preference_loss_sql())
def q_preference_loss(spark, sf):
    """A11 on consecutive-answer preference pairs with length-derived sequence log-probabilities."""
    p = fx.preferences(spark, sf)
    p = p.select("conv_id", "turn",
                 (-(F.octet_length("chosen") % 97) / 10.0).alias("pc"), (-(F.octet_length("rejected") % 89) / 10.0).alias("pr"),
                 (-(F.length("chosen") % 83) / 10.0).alias("rc"), (-(F.length("rejected") % 79) / 10.0).alias("rr"))
    out = adv.preference_loss(p, beta=0.15)
    return out.select("conv_id", "turn", rl.r6("margin").alias("margin"), rl.r6("loss").alias("loss"))


@register("step_counts", oracles.step_counts_sql())
def q_step_counts(spark, sf):
    """A16 per language: batches after a one-batch resume skip, optimizer steps over two epochs."""
    return mt.step_counts(read_table(spark, sf, "documents"), ["lang"], 16, 8, 2, skip=1)


@register("decode_roundtrip", oracles.decode_roundtrip_sql())
def q_decode_roundtrip(spark, sf):
    """decode(encode(text)) == text for every document."""
    d = spread(read_table(spark, sf, "documents").select("lang", "text"))
    d = d.withColumn("back", tk.decode_bytes(tk.encode_bytes("text"), skip_special=False))
    return d.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                 F.sum((F.col("back") != F.col("text")).cast("long")).cast("long").alias("n_fail"))


@register("doc_sequences", oracles.doc_sequences_sql())
def q_doc_sequences(spark, sf):
    """Q1 wrap, Q2 pad, Q3 pad labels, Q8 shift, Q10 left truncate/pad, Q13, Q15, Q16 over every document."""
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    d = d.withColumn("ids", tk.encode_bytes("text"))
    s = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    padded = sq.pad_right("ids", 2048)
    x, y = sq.shift_xy(sq.pad_right("ids", 512))
    lids, lmask = sq.left_truncate_pad("ids", 256)
    lp = F.transform("ids", lambda t: -t / 1000.0)
    aligned = sq.align_logprobs(lp, 300)
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        s(sq.wrap_truncate("ids", 128)).alias("wrap_sum"),
        F.size(F.filter(sq.mask_pad_labels(padded), lambda v: v == -100)).cast("long").alias("n_pad"),
        F.aggregate(F.filter(lids, lambda v: v != 0), F.lit(0).cast("long"), lambda a, v: a + v).alias("left_sum"),
        sq.first_supervised_pos(lmask).alias("first_pos"),
        s(sq.first_eos_mask(lids, lmask)).alias("eos_mask_sum"),
        (s(x) - s(y)).alias("shift_delta"),
        rl.r6(F.aggregate(aligned, F.lit(0.0), lambda a, v: a + v)).alias("aligned_sum"))


# ---- tokenizer training -------------------------------------------------------------------------

from tessera.operators import bpe  # noqa: E402


def _trained(spark, sf):
    """T2 -> T4 -> T5 on all conversation turns (S6-shaped corpus): every merge of the 6,400-id vocabulary."""
    return bpe.train_bpe(tk.word_counts(read_table(spark, sf, "conversations").select("text"), "text"))


@register("bpe_train")
def q_bpe_train(spark, sf):
    """All merges in order.  Rows-only here; the tests compare every merge and id with the public trainer's."""
    merges = _trained(spark, sf)
    names = spark.createDataFrame(sorted(bpe.token_strings(bpe.merge_table(merges)).items()), "id int, token string")
    return merges.join(F.broadcast(names), "id").select("rank", "left", "right", "id", "count", "token")


# ---- preference pairs, batching, corpus reports -----------------------------------------------

from tessera.plans import sft as sft_jobs  # noqa: E402


def _md5_of(array) -> F.Column:
    return F.md5(F.array_join(F.transform(array, lambda x: x.cast("string")), ","))


@register("preference_pairs", oracles.preference_pairs_sql())
def q_preference_pairs(spark, sf, max_len=512, seed=42):
    """Q9: the six arrays of every pair, by digest."""
    p = fx.preferences(spark, sf).withColumns({side: F.array(ch.make_message(F.lit("assistant"), F.col(side))) for side in ("chosen", "rejected")})
    arrays = sft_jobs.preference_samples(p, ["conv_id", "turn"], max_len, seed)
    return arrays.select("conv_id", "turn", *[_md5_of(c).alias(c) for c in arrays.columns[2:]])


@register("pretrain_samples", oracles.pretrain_samples_sql())
def q_pretrain_samples(spark, sf, max_len=512):
    """The pretraining job over every document (T6, Q1, Q2, Q3), by digest."""
    p = sft_jobs.pretrain_samples(read_table(spark, sf, "documents"), "doc_id", "text", max_len)
    return p.select("doc_id", _md5_of("input_ids").alias("ids_md5"), _md5_of("labels").alias("labels_md5"))


@register("pad_to_batch", oracles.pad_to_batch_sql())
def q_pad_to_batch(spark, sf, n_batches=5):
    """Q12: ids, masks and log-probabilities of the sequences of a batch (prompt_id mod 5), padded alike."""
    t = fx.token_logps(spark, sf)
    seq = t.groupBy("prompt_id", "gen_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lp_new", "mask"))).alias("_s"))
    seq = seq.select("gen_id", (F.col("prompt_id") % n_batches).alias("batch"), F.transform("_s", lambda x: x["pos"] % 50 + 1).alias("ids"),
                     F.col("_s.mask").alias("mask"), F.col("_s.lp_new").alias("logp"))
    padded = sq.pad_to_batch(seq, "batch", {"ids": F.lit(0), "mask": F.lit(0), "logp": F.lit(0.0)})
    fiftieths = F.transform("logp", lambda x: F.round(x * 50).cast("int"))
    return padded.select("gen_id", "batch", F.size("ids").cast("long").alias("padded_len"), _md5_of("ids").alias("ids_md5"),
                         _md5_of("mask").alias("mask_md5"), _md5_of(fiftieths).alias("logp_md5"))


@register("supervised_filter", oracles.supervised_filter_sql(256))
def q_supervised_filter(spark, sf, max_len=256):
    """Drop samples with no supervised label after truncation; report the supervised share."""
    r = _sft_report(read_table(spark, sf, "conversations"), max_len=max_len)
    return r.filter(F.col("n_supervised") > 0).select(
        "conv_id", "n_supervised", rl.r6(F.col("n_supervised") / F.lit(float(max_len))).alias("supervised_share"))


@register("distinct_ngrams", oracles.distinct_ngrams_sql())
def q_distinct_ngrams(spark, sf):
    """D2 per language: distinct-1 and distinct-2 over whitespace words of all documents."""
    from tessera.functions.text import PY_SPACE_CLASS
    d = spread(read_table(spark, sf, "documents").select("lang", "text"))
    w = d.select("lang", F.array_remove(F.split("text", "[" + PY_SPACE_CLASS + "]+"), "").alias("w"))
    # outer forms: for the others Spark adds a filter on the arrays' sizes, which splits every text twice
    uni = w.select("lang", F.explode_outer("w").alias("g")).where("g is not null")
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("w", 1, rest).alias("a"), F.slice("w", 2, rest).alias("b"))   # words hold no blank, so a pair is its two words
    bi = w.select("lang", F.inline_outer(pairs)).where("a is not null")
    a1 = uni.groupBy("lang").agg(F.count(F.lit(1)).alias("n1"), F.countDistinct("g").alias("d1"))
    a2 = bi.groupBy("lang").agg(F.count(F.lit(1)).alias("n2"), F.countDistinct("a", "b").alias("d2"))
    j = a1.join(a2, "lang", "left")
    return j.select("lang", F.col("n1").cast("long").alias("n_words"),
                    rl.r6(F.col("d1") / F.col("n1")).alias("distinct_1"),
                    rl.r6(F.col("d2") / F.col("n2")).alias("distinct_2"))


@register("pretrain_mix", oracles.pretrain_mix_sql(0.15))
def q_pretrain_mix(spark, sf, share=0.15, seed=42):
    """D3: SFT conversations plus a keyed ~15 % sample of pretraining documents, as one table."""
    from tessera.functions.rand import keyed_uniform
    conv = conversations_from_turns(read_table(spark, sf, "conversations"))
    sft = conv.select(F.lit("sft").alias("source"), F.col("conv_id").alias("id"),
                      F.size("conversations").cast("long").alias("n_parts"))
    docs = read_table(spark, sf, "documents").filter(keyed_uniform("doc_id", "mix", seed) < share)
    pre = docs.select(F.lit("pretrain").alias("source"), F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n_parts"))
    return sft.unionByName(pre)


@register("join_logps", oracles.join_logps_sql())
def q_join_logps(spark, sf):
    """Policy, reference and rollout log-probs from three tables aligned on (prompt, gen, pos)."""
    t = fx.token_logps(spark, sf)
    k = ["prompt_id", "gen_id", "pos"]
    pol, ref, old = t.select(*k, "lp_new"), t.select(*k, "lp_ref"), t.select(*k, "lp_old", "mask")
    j = pol.join(ref, k).join(old, k)
    return j.groupBy("gen_id").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        rl.r6(F.sum((F.col("lp_new") - F.col("lp_ref")) * F.col("mask"))).alias("sum_new_minus_ref"),
        rl.r6(F.sum((F.col("lp_new") - F.col("lp_old")) * F.col("mask"))).alias("sum_new_minus_old"))


@register("pair_random", oracles.pair_random_sql())
def q_pair_random(spark, sf, seed=42):
    """Every embedding row paired with one page drawn uniformly (with replacement)."""
    pages = read_table(spark, sf, "pages").select("page_id").orderBy("page_id")
    left = read_table(spark, sf, "embeddings").select("vec_id")
    return lk.pair_random(left, pages, "vec_id", seed).select("vec_id", "page_id")


# ---- array augmentation -------------------------------------------------------------------------

@register("augment_embeddings", oracles.augment_embeddings_sql())
def q_augment_embeddings(spark, sf, seed=42):
    """G1 (noise, gain, silence, moving average, clip; 32 samples a second) and G2 (feature / frame masks on 8x8 frames) per embedding,
    as sums and as digests of the values in millionths."""
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.select("vec_id", au.augment_signal("x", "vec_id", seed, rate=32).alias("sig"), au.mask_features("x", 8, "vec_id", seed).alias("msk"))
    micro = lambda a: F.md5(F.array_join(F.transform(a, lambda v: F.floor(v * 1e6 + 0.5).cast("string")), ","))
    tot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return e.select("vec_id", rl.r6(tot("sig")).alias("signal_sum"), rl.r6(tot("msk")).alias("masked_sum"),
                    micro("sig").alias("signal_md5"), micro("msk").alias("masked_md5"))


@register("truncate_to_turn", oracles.truncate_to_turn_sql(768))
def q_truncate_to_turn(spark, sf, max_len=768):
    """P11 over every conversation; those with fewer than two assistant turns stay whole (byte-vocabulary lengths)."""
    conv = conversations_from_turns(read_table(spark, sf, "conversations"))
    c = conv.withColumn("cut", ch.truncate_to_turn("conversations", "conv_id", max_len))
    return c.select("conv_id", F.size("cut").cast("long").alias("n_kept"),
                    tk.byte_token_count(ch.render_chat("cut")).cast("long").alias("n_tokens"))


@register("layered_loss", oracles.layered_loss_sql())
def q_layered_loss(spark, sf):
    """A10 over the audio-code layers (Q18, stop code appended) with a code-derived per-position loss."""
    codes = fx.audio_codes(spark, sf)
    seqs = codes.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_s"))
    layers = seqs.select("vec_id", F.posexplode(au.audio_code_layers(F.col("_s.code"))).alias("layer", "codes"))
    t = layers.select("vec_id", "layer", F.explode("codes").alias("target"))
    t = t.withColumn("loss", (F.col("target") % 97) / 97.0)
    out = au.layered_loss(t, ["vec_id"])
    return out.select("vec_id", rl.r6("audio_loss").alias("audio_loss"))


# ---- prompt assembly ----------------------------------------------------------------------------

@register("eval_prompts", oracles.eval_prompts_sql())
def q_eval_prompts(spark, sf, langs=("zh", "en")):
    """P20: every user turn as a chat evaluation prompt (generation prompt, thinking closed), fanned out
    over languages."""
    t = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    p = t.select("conv_id", "turn", F.explode(ch.build_eval_prompts(F.col("text"), langs=list(langs))).alias("x"))
    return p.select("conv_id", "turn", F.col("x.lang").alias("lang"), F.md5("x.prompt").alias("prompt_md5"),
                    F.length("x.prompt").cast("long").alias("prompt_len"))


@register("media_prompts", oracles.media_prompts_sql())
def q_media_prompts(spark, sf):
    """P20 with media: every user turn with audio pads (conv_id mod 5 frames, none where turn mod 3 is 0) and image pads (64, none where conv_id is
    odd), as chat evaluation prompts."""
    t = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    frames = F.when(F.col("turn") % 3 != 0, F.col("conv_id") % 5)
    prompt = ch.build_eval_prompts(ch.media_prompt("text", frames, F.when(F.col("conv_id") % 2 == 0, F.lit(64))))
    p = t.select("conv_id", "turn", prompt.alias("p"))
    return p.select("conv_id", "turn", F.md5("p").alias("prompt_md5"), F.length("p").cast("long").alias("prompt_len"))


@register("speech_media", oracles.speech_media_sql())
def q_speech_media(spark, sf):
    """Q25 over every conversation: a question audio per user message (empty where its length mod 4 is 0, one too few where conv_id mod 3 is 0),
    codes per answer (one too few where conv_id mod 5 is 0), valid frames by text length mod 7."""
    conv = conversations_from_turns(read_table(spark, sf, "conversations"))
    of = lambda role: F.transform(F.filter("conversations", lambda m: m["role"] == role), lambda m: m["content"])
    fewer = lambda a, n: F.slice(a, 1, F.greatest(F.size(a) - F.when(F.col("conv_id") % n == 0, 1).otherwise(0), F.lit(0)))
    c = conv.select("conv_id", "conversations", of("user").alias("u"), of("assistant").alias("a"))
    m = au.select_media("conversations", F.transform(fewer(F.col("u"), 3), lambda x: F.when(F.length(x) % 4 == 0, F.lit("")).otherwise(x)),
                        F.transform(fewer(F.col("a"), 5), lambda x: F.array(F.length(x))),
                        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("img"))).otherwise(F.array().cast("array<string>")),
                        F.transform("u", lambda x: F.length(x) % 7))
    r = c.select("conv_id", m.alias("m"))
    return r.select("conv_id", F.md5("m.question_audio").alias("audio_md5"), F.col("m.audio_length").cast("long").alias("audio_length"),
                    F.col("m.audio_tokens").cast("long").alias("audio_tokens"), F.get("m.answer_codes", F.lit(0)).cast("long").alias("first_code"),
                    F.col("m.image").alias("image"))


@register("audio_placeholders", oracles.audio_placeholders_sql())
def q_audio_placeholders(spark, sf, seed=42):
    """P10: audio pads (conv_id mod 5 frames) placed in each conversation's last user message."""
    conv = conversations_from_turns(read_table(spark, sf, "conversations"))
    n = (F.col("conv_id") % 5).cast("int")
    c = conv.withColumn("c2", ch.insert_audio_placeholder("conversations", n, "conv_id", seed))
    last_user = F.element_at(F.filter("c2", lambda m: m["role"] == "user"), -1)
    return c.filter(F.exists("conversations", lambda m: m["role"] == "user")) \
        .select("conv_id", F.md5(last_user["content"]).alias("last_user_md5"))


@register("bpe_compression")
def q_bpe_compression(spark, sf):
    """T5 -> T6 -> T9: every document encoded with the whole trained vocabulary, compression per language (rows-only;
    encoding parity is tested against the public library)."""
    from tessera.plans.tokenizer_job import evaluate
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "text"))
    out = evaluate(docs, "text", "doc_id", _trained(spark, sf), ["lang"])
    return out.select("lang", "n_rows", "n_tokens", rl.r6("chars_per_token").alias("chars_per_token"), "n_fail")


@register("bpe_roundtrip", """
select lang, count(*)::bigint as n_rows, md5(string_agg(md5(text), '' order by doc_id)) as texts_md5 from documents group by lang""")
def q_bpe_roundtrip(spark, sf):
    """T6 -> T7 with the whole trained vocabulary: what comes back of every document, by digest."""
    from tessera.plans.tokenizer_job import decode_with
    merges = _trained(spark, sf)
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "text"))
    back = docs.withColumn("ids", bpe.encode_bpe_column("text", merges)).select("doc_id", "lang", F.md5(decode_with(merges, "ids")).alias("m"))
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "m"))), lambda x: x["m"]), "")).alias("texts_md5"))


@register("voice_names", oracles.voice_names_sql())
def q_voice_names(spark, sf):
    """Candidate voice names of customers (their name, nation and number with odd blanks, reserved, blank) against a registry of
    customers' names (key mod 3 = 0 builtin, = 1 manual)."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    k = F.col("c_custkey") % 4
    cand = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        "c_custkey",
        F.when(k == 0, F.col("c_name"))
         .when(k == 1, F.concat(F.col("n_name"), F.lit("  \t"), F.col("c_custkey").cast("string"), F.lit(" ")))
         .when(k == 2, F.lit("Default")).otherwise(F.lit("  ")).alias("name"))
    reg = c.filter(F.col("c_custkey") % 3 != 2).select(
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("builtin")).otherwise(F.lit("manual")).alias("grp"))
    out = ch.validate_voice_names(cand, reg)
    return out.select("c_custkey", "voice", F.coalesce("reject", F.lit("ok")).alias("verdict"))
