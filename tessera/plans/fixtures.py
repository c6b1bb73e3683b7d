"""Derived inputs the provided tables lack (FIXTURES.md §3), computed by Spark from those tables.

Each is a deterministic function of a provided table, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import number_within, read_table, with_group_count

# --- fixed values (fixture formulas of FIXTURES.md) -----------------------------
TOOL_CALL_RATE = ('<tool_call>{"name": "get_exchange_rate", "arguments": {"from_currency": "', '", "to_currency": "CNY"}}</tool_call> 7.21')
CURRENCIES = ("USD", "EUR", "GBP", "XXX")   # by conv_id % 4; the last has no rate
TOOL_CALL_BAD = ('<tool_call>{"name": "calculate_math", "arguments": {"expression": ""}}</tool_call>'
                 '<tool_call>{bad</tool_call>')
# ---------------------------------------------------------------------------------


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """(prompt_id, gen_id, turn, mode, completion): assistant turns as model completions."""
    a = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    mode = ((F.col("conv_id") + F.col("turn")) % 6).cast("int")
    t = F.col("text")
    currency = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.col("conv_id") % 4 + 1).cast("int"))
    completion = (F.when(mode == 0, t)
                  .when(mode == 1, F.concat(F.substring(t, 1, 60), F.lit("</think>"), F.expr("substring(text, 61)")))
                  .when(mode == 2, F.concat(t, F.lit(TOOL_CALL_RATE[0]), currency, F.lit(TOOL_CALL_RATE[1])))
                  .when(mode == 3, F.concat(t, F.lit(TOOL_CALL_BAD)))
                  .when(mode == 4, F.concat_ws(" ", t, t, t))
                  .otherwise(F.concat(F.lit("<tool_call>"), t)))
    return a.select(F.col("conv_id").alias("prompt_id"), (F.row_number().over(w) - 1).cast("long").alias("gen_id"),
                    "turn", mode.alias("mode"), completion.alias("completion"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """(from_currency, to_currency, rate) of the first three nations' keys."""
    n = read_table(spark, sf, "nation").where("n_nationkey < 3")
    name = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.col("n_nationkey") + 1).cast("int"))
    return n.select(name.alias("from_currency"), F.lit("CNY").alias("to_currency"), (7 + F.col("n_nationkey") / F.lit(8.0)).alias("rate"))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """(prompt_id, tools, gt, unfinished) per conversation."""
    c = read_table(spark, sf, "conversations").select("conv_id").distinct()
    k3, k4 = F.col("conv_id") % 3, F.col("conv_id") % 4
    tools = (F.when(k3 == 0, F.array(F.lit("get_exchange_rate")))
             .when(k3 == 1, F.array(F.lit("get_exchange_rate"), F.lit("calculate_math")))
             .otherwise(F.array().cast("array<string>")))
    gt = (F.when(k4 == 0, F.array(F.lit("7.21"))).when(k4 == 1, F.array().cast("array<string>"))
          .when(k4 == 2, F.array(F.lit("7.21"), F.lit("7.21"))).otherwise(F.array(F.lit("7,210"))))
    return c.select(F.col("conv_id").alias("prompt_id"), tools.alias("tools"), gt.alias("gt"),
                    (F.col("conv_id") % 11 == 0).alias("unfinished"))


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, chosen, rejected): consecutive assistant turns, chosen = smaller md5."""
    a = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = a.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")) \
        .filter(F.col("b").isNotNull())
    first = F.md5("a") < F.md5("b")
    return p.select("conv_id", "turn", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"),
                    F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"))


def token_logps(spark: SparkSession, sf: str) -> DataFrame:
    """Per-token rollout table from events: (prompt_id, gen_id, pos, lp_new, lp_old, lp_ref, mask, v, reward).

    Positions come from ``number_within`` (global sort + offsets) and sequence lengths from a grouped count,
    so a user holding a large share of the events is not numbered inside one task."""
    e = read_table(spark, sf, "events").select("event_id", "ts", "user_id")
    e = with_group_count(number_within(e, ["user_id"], ["ts", "event_id"], "pos"), ["user_id"], "_n")
    eid = F.col("event_id")
    return e.select(
        (F.col("user_id") % 40).alias("prompt_id"), F.col("user_id").alias("gen_id"),
        F.col("pos").cast("int").alias("pos"),
        (-(1 + eid % 97) / F.lit(50.0)).alias("lp_new"), (-(1 + eid % 89) / F.lit(50.0)).alias("lp_old"),
        (-(1 + eid % 83) / F.lit(50.0)).alias("lp_ref"), (eid % 7 < 6).cast("int").alias("mask"),
        ((eid % 101) / F.lit(100.0)).alias("v"),
        F.when(F.col("pos") == F.col("_n") - 1, (F.col("user_id") % 7) / F.lit(2.0)).otherwise(F.lit(0.0))
        .alias("reward"))


def prefix_masked(tokens: DataFrame) -> DataFrame:
    """Response masks as rollouts have them, a prefix of the sequence: none of it for gen_id % 3 = 0, the first 20 positions
    for 1, all for 2."""
    g = F.col("gen_id") % 3
    return tokens.withColumn("mask", F.when(g == 0, 0).when(g == 1, (F.col("pos") < 20).cast("int")).otherwise(1))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """(prompt_id, completion, turn_outputs): all completions of a conversation as the turns of one rollout."""
    r = rollouts(spark, sf).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("turn", "completion"))).alias("t"))
    return r.select("prompt_id", F.lit(0).cast("long").alias("gen_id"), F.col("t.completion").alias("turn_outputs")).withColumn(
        "completion", F.array_join("turn_outputs", "\n"))


def audio_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(session_id, seq, prob, generating): one 512-sample window per event; a reply is in progress on
    'view' events (drives X2 interrupts)."""
    e = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "props", "event_type")
    e = number_within(e, ["user_id"], ["ts", "event_id"], "seq")
    return e.select(F.col("user_id").alias("session_id"), F.col("seq").cast("int").alias("seq"),
                    (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("prob"),
                    (F.col("event_type") == "view").alias("generating"))


def audio_codes(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, pos, code): 64 codes per embedding = 8 frames x 8 layers, frame-major."""
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "pos", (F.floor(F.abs(F.col("x").cast("double")) * 8192).cast("int") % 2048).alias("code"))


def waveforms(spark: SparkSession, sf: str) -> DataFrame:
    """(clip_id, pos, amp): embeddings of one label concatenated in vec_id order (vec_ids are unique, so the
    rank inside a label is a position from ``number_within``)."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    r = number_within(e, ["label"], ["vec_id"], "k")
    return r.select(F.col("label").alias("clip_id"), "k", F.posexplode("embedding").alias("i", "x")).select(
        "clip_id", (F.col("k") * 64 + F.col("i")).alias("pos"), F.col("x").cast("double").alias("amp"))


def scored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(grp, item, score) from lineitem."""
    li = read_table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("grp"), F.row_number().over(w).cast("long").alias("item"),
                     (F.col("l_quantity") / F.lit(10.0)).alias("score"))


def image_tagged_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with ``<image>`` tags injected by the first md5 hex digit."""
    c = read_table(spark, sf, "conversations")
    h = F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 1)
    text = (F.when(h < "4", F.concat(F.lit("<image>"), F.col("text")))
            .when(h < "8", F.concat(F.col("text"), F.lit(" <image> x"))).otherwise(F.col("text")))
    return c.withColumn("text", text)


#: When the feed of ``lossy_chunks`` begins.
EPOCH_MS = 1_700_000_000_000


def lossy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Audio chunks with an event time (32 ms a window), some windows of each session lost on the way."""
    c = audio_chunks(spark, sf).where((F.col("seq") * 7 + F.col("session_id")) % 13 != 5)
    return c.withColumn("at", F.timestamp_millis(EPOCH_MS + F.col("seq") * 32 + F.col("session_id") % 7 * 10))


def reply_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, seq, delta, last): each turn as a streamed reply in deltas of seven characters, with a reasoning part unless turn mod 5
    is 0 and a tool call at its end where turn mod 4 is 1."""
    t = read_table(spark, sf, "conversations")
    plan = F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("plan "), F.md5("text"), F.lit("</think>\n\n")))
    call = F.when((F.col("turn") % 4 == 1) & (F.col("turn") % 5 != 0), F.lit('<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>')).otherwise("")
    whole = F.concat(plan, F.translate("text", "<", "("), call)
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), whole.alias("w")).withColumn("n", F.ceil(F.length("w") / 7).cast("int"))
    t = t.where("n > 0").select("request_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return t.select("request_id", F.col("i").cast("long").alias("seq"), F.substr("w", F.col("i") * 7 + 1, F.lit(7)).alias("delta"),
                    (F.col("i") == F.col("n") - 1).alias("last"))


def ordered_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, seq, role, text, last): messages numbered from 0 in their conversation."""
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.withColumns({"seq": (F.row_number().over(w) - 1).cast("long"), "last": F.lead("turn").over(w).isNull()}).drop("turn")


def session_frames(spark: SparkSession, sf: str) -> DataFrame:
    """(session_id, seq, frame, last): a code per window of a session."""
    c = audio_chunks(spark, sf).select("session_id", F.col("seq").cast("long").alias("seq"), F.format_string("%d:%.2f", "seq", "prob").alias("frame"))
    n = c.groupBy("session_id").agg(F.max("seq").alias("_m"))
    return c.join(n, "session_id").withColumn("last", F.col("seq") == F.col("_m")).drop("_m")


def rollout_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of multi-turn rollouts from the first four messages of each conversation, as character codes: 0 and 2 (pad, end) among the new
    ids; new contexts that go on from the old, or come out shorter where the turn and conversation are of one parity."""
    t = ordered_messages(spark, sf).where("seq < 4").select("conv_id", F.col("seq").cast("int").alias("turn"), F.md5("text").alias("h"))
    codes = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    n = F.col("conv_id") % 9 + F.col("turn") * 3 + 4
    new = F.substr("h", F.lit(1), n)
    context = F.concat(F.lit("ask "), F.col("conv_id").cast("string"), F.repeat(F.lit("+"), F.col("turn") * 20))
    longer = F.concat(context, new, F.lit("obs"), F.substr("h", F.lit(1), F.lit(20) - F.col("turn") * 5))
    observe = F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.lit("short")).otherwise(longer)
    new_ids = F.concat(F.array(F.lit(0)), codes(new), F.array(F.lit(2)))
    return t.select("conv_id", "turn", codes(context).alias("context_ids"), new_ids.alias("new_ids"),
                    F.transform(new_ids, lambda x: -x / F.lit(100.0)).alias("new_logps"),
                    F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, 0).otherwise(1).alias("calls"), codes(observe).alias("observe_ids"))
