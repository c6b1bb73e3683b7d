"""Rollout scoring (P13-P17, J2-J4, J8, J10, A1-A7) as native column expressions and joins.

A rollout row carries its completion text; a task row carries the allowed tool names and the
ground-truth list.  Scores are computed per row after one equi-join on ``prompt_id`` (J2);
nothing in the reward path needs a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.functions.text import PY_SPACE_CLASS, count_sub, py_strip

# Unicode classes matching Python's ``\w`` (letters, numbers, underscore) and ``\s`` for str patterns.
WORD = r"\p{L}\p{N}_"
SPACE = PY_SPACE_CLASS
REP_TOKEN_PATTERN = f"[{WORD}]+|[^{WORD}{SPACE}]"
NUMBER_PATTERN = rf"(?<![{WORD}.])[-+]?\p{{Nd}}+(?:\.\p{{Nd}}+)?(?![{WORD}.])"
TOOL_CALL_PATTERN = r"(?s)<tool_call>(.*?)</tool_call>"
# fixed value: the sentence between the dialogue history and the last question
HISTORY_JOIN = "\n以上是对话历史。我的新问题是：\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- P15 / P16 / P17 / P18 --------------------------------------------------------

def split_think(text) -> tuple[Column, Column, Column]:
    """P15 (ii): (has_think_end, think, answer) split once at the first ``</think>``; answer stripped."""
    text = _c(text)
    has = F.instr(text, "</think>") > 0
    parts = F.split(text, "</think>", 2)
    think = F.when(has, F.element_at(parts, 1))
    answer = F.when(has, py_strip(F.element_at(parts, 2))).otherwise(py_strip(text))
    return has, think, answer


def strip_think_api(text) -> tuple[Column, Column]:
    """P15 (iii): (content, reasoning) -- every ``<think>..</think>`` (and trailing spaces) removed, the
    first one's body is the reasoning; else split on the first bare ``</think>``."""
    text = _c(text)
    pat = r"(?s)<think>(.*?)</think>\s*"
    has_pair = F.regexp_like(text, F.lit(r"(?s)<think>.*?</think>"))
    reasoning_pair = py_strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))
    content_pair = py_strip(F.regexp_replace(text, pat, ""))
    has_end = F.instr(text, "</think>") > 0
    parts = F.split(text, "</think>", 2)
    reasoning = F.when(has_pair, reasoning_pair).when(has_end, py_strip(F.element_at(parts, 1)))
    content = F.when(has_pair, content_pair).when(has_end, py_strip(F.element_at(parts, 2))).otherwise(py_strip(text))
    return content, reasoning


JSON_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
               "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}


def parse_json_object(text, schema: str) -> Column:
    """``from_json`` that yields null unless ``text`` is one well-formed JSON object (like ``json.loads``
    followed by a dict check); the parser records malformed input in a corrupt-record field."""
    t = _c(text)
    j = F.from_json(t, schema + ", _corrupt string", JSON_STRICT)
    is_obj = F.regexp_like(t, F.lit(r"(?s)^\s*\{.*\}\s*$"))
    return F.when(j.isNotNull() & j["_corrupt"].isNull() & is_obj, j.dropFields("_corrupt"))


def extract_tool_calls(text) -> Column:
    """P16 (i): ``array<struct<idx, name, arguments>>`` of the ``<tool_call>`` bodies that parse as a JSON
    object; bad JSON is skipped (``idx`` counts all matches, 0-based)."""
    bodies = F.regexp_extract_all(_c(text), F.lit(TOOL_CALL_PATTERN), 1)
    parsed = F.transform(bodies, lambda b, i: F.struct(
        i.alias("idx"), parse_json_object(py_strip(b), "name string, arguments string").alias("j")))
    ok = F.filter(parsed, lambda p: p["j"].isNotNull())
    return F.transform(ok, lambda p: F.struct(p["idx"].alias("idx"), p["j"]["name"].alias("name"),
                                              p["j"]["arguments"].alias("arguments")))


def extract_tool_calls_api(text) -> Column:
    """P16 (ii): bodies of the form ``{...}`` as ``array<struct<id, name, arguments>>``; ``call_i`` counts all such bodies, bad
    JSON is skipped, null if none parses.  A missing name is empty, missing arguments are ``{}``."""
    bodies = F.regexp_extract_all(_c(text), F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), 1)
    parsed = F.transform(bodies, lambda b, i: F.struct(i.alias("idx"), parse_json_object(b, "name string, arguments string").alias("j")))
    calls = F.transform(F.filter(parsed, lambda p: p["j"].isNotNull()), lambda p: F.struct(
        F.concat(F.lit("call_"), p["idx"].cast("string")).alias("id"), F.coalesce(p["j"]["name"], F.lit("")).alias("name"),
        F.coalesce(p["j"]["arguments"], F.lit("{}")).alias("arguments")))
    return F.when(F.size(calls) > 0, calls)


def without_tool_calls(text) -> Column:
    """P16 (iii): the text without its ``<tool_call>`` blocks if at least one parses, else the text; stripped."""
    text = _c(text)
    bare = F.regexp_replace(text, TOOL_CALL_PATTERN, "")
    return py_strip(F.when(F.size(extract_tool_calls(text)) > 0, bare).otherwise(text))


def parse_tool_arguments(raw) -> Column:
    """Argument text -> ``map<string,string>``; unparsable or missing -> empty map."""
    return F.coalesce(F.from_json(_c(raw), "map<string,string>"), F.create_map().cast("map<string,string>"))


def tool_result_text(result_json, limit: int = 2048) -> Column:
    """The tool result's JSON text, or ``{"error": "tool not found"}`` when missing or empty (``{}``, ``[]``, ``null``,
    ``""``, ``0``, ``false``); cut to ``limit`` characters, the tool protocol's own limit."""
    r = _c(result_json)
    return F.left(F.when(~F.coalesce(F.trim(r), F.lit("")).isin("", "{}", "[]", "null", '""', "0", "0.0", "false"), r)
                  .otherwise(F.lit('{"error": "tool not found"}')), F.lit(limit))


# ---- U2 / J3: argument predicates ---------------------------------------------------

class Arguments:
    """The arguments of a call with their JSON types kept."""

    def __init__(self, raw: Column):
        self.parsed = F.try_parse_json(raw)

    def _of(self, key: str) -> tuple[Column, Column]:
        own = F.try_variant_get(self.parsed, f"$.{key}", "variant")
        return F.schema_of_variant(own), F.try_variant_get(self.parsed, f"$.{key}", "string")

    def has(self, key: str) -> Column:
        """The key is there with a value other than null."""
        return F.coalesce(self._of(key)[0] != "VOID", F.lit(False))

    def truthy(self, key: str) -> Column:
        """False for a missing key, null, an empty string, list or object, false, and zero; the string "0" is true."""
        kind, text = self._of(key)
        return F.coalesce(F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true")
                          .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}")
                          .when(kind == "VOID", F.lit(False)).otherwise(text.try_cast("double") != 0), F.lit(False))


# name -> predicate over the call's arguments (a registry of SQL expressions)
ARG_PREDICATES = {
    "calculate_math": lambda a: a.truthy("expression"),
    "unit_converter": lambda a: a.has("value") & a.truthy("from_unit") & a.truthy("to_unit"),
    "get_current_weather": lambda a: a.truthy("location"),
    "get_current_time": lambda a: F.lit(True),
    "get_exchange_rate": lambda a: a.truthy("from_currency") & a.truthy("to_currency"),
    "translate_text": lambda a: a.truthy("text") & a.truthy("target_language"),
}


def call_is_valid(call: Column, tool_names: Column) -> Column:
    """J3 for one call: its name is among the task's tools and its argument predicate holds."""
    args = Arguments(call["arguments"])
    pred = F.lit(False)
    for name, fn in reversed(list(ARG_PREDICATES.items())):
        pred = F.when(call["name"] == name, fn(args)).otherwise(pred)
    return F.coalesce(F.array_contains(F.coalesce(tool_names, F.array().cast("array<string>")), call["name"]),
                      F.lit(False)) & F.coalesce(pred, F.lit(False))


def valid_tool_calls(calls, tool_names) -> Column:
    """Number of valid calls."""
    return F.size(F.filter(_c(calls), lambda c: call_is_valid(c, _c(tool_names))))


# ---- A1 / A2 / A3 / A4 / J8 ---------------------------------------------------------

def rep_penalty(text, n: int = 3, cap: float = 0.5) -> Column:
    """A1: share of repeated word n-grams of the lower-cased text, scaled and capped."""
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(REP_TOKEN_PATTERN), 0)

    def pen(tk):
        n_grams = F.size(tk) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n_grams, F.lit(1))),
                            lambda i: F.array_join(F.slice(tk, i, n), " "))
        distinct = F.size(F.array_distinct(grams))
        p = F.least(F.lit(cap), (n_grams - distinct) * F.lit(cap * 2) / n_grams)
        return F.when(n_grams > 0, p).otherwise(F.lit(0.0))

    return let(toks, pen)


def format_score(text, lo: int = 20, hi: int = 800, think_lo: int = 20, think_hi: int = 300) -> Column:
    """A2: length score, plus think-length and single-close scores when ``</think>`` is present."""
    text = _c(text)
    n = F.length(py_strip(text))
    s = F.when((n >= lo) & (n <= hi), F.lit(0.5)).otherwise(F.lit(-0.5))
    has, think, _ = split_think(text)
    tn = F.length(py_strip(think))
    think_s = F.when((tn >= think_lo) & (tn <= think_hi), F.lit(1.0)).otherwise(F.lit(-0.5))
    close_s = F.when(count_sub(text, "</think>") == 1, F.lit(0.25)).otherwise(F.lit(-0.25))
    return s + F.when(has, think_s + close_s).otherwise(F.lit(0.0))


def tag_imbalance(texts) -> Column:
    """A3: -0.5 * sum over turns of |#<tool_call> - #</tool_call>|."""
    per = F.transform(_c(texts), lambda t: F.abs(count_sub(t, "<tool_call>") - count_sub(t, "</tool_call>")))
    return F.lit(-0.5) * F.aggregate(per, F.lit(0), lambda a, x: a + x)


def tool_gap(valid, total, n_gt) -> Column:
    """A4: +0.5 when the valid-call count equals |gt| and no call is invalid, else -0.5 * gap."""
    gap = F.abs(_c(valid) - _c(n_gt)) + F.greatest(F.lit(0), _c(total) - _c(valid))
    return F.when(gap == 0, F.lit(0.5)).otherwise(F.lit(-0.5) * gap)


def numbers_in(text) -> Column:
    """Standalone numbers of a text (commas removed first), as doubles."""
    t = F.replace(_c(text), F.lit(","), F.lit(""))
    return F.transform(F.regexp_extract_all(t, F.lit(NUMBER_PATTERN), 0), lambda x: x.try_cast("double"))


def match_ground_truth(text, gt) -> Column:
    """Number of *distinct* gt values matched: case-insensitive substring of the stripped value, or a
    numeric value within 1e-6 of a standalone number of the text."""
    text, gt = _c(text), _c(gt)
    ctx = F.struct(numbers_in(text).alias("nums"), F.lower(text).alias("low"))
    return let(ctx, lambda c: _count_matches(c["nums"], c["low"], gt))


def _count_matches(nums: Column, low: Column, gt: Column) -> Column:
    def matches(g):
        s = py_strip(g)
        sn = F.replace(s, F.lit(","), F.lit(""))
        sub = (F.length(s) > 0) & F.contains(low, F.lower(s))
        num = F.regexp_like(sn, F.lit(r"^[-+]?\p{Nd}+(?:\.\p{Nd}+)?$")) & \
            F.exists(nums, lambda x: F.abs(sn.try_cast("double") - x) < 1e-6)
        return F.coalesce(sub | num, F.lit(False))

    return F.size(F.filter(F.array_distinct(F.coalesce(gt, F.array().cast("array<string>"))), matches))


# ---- J2 / J4 / J10 ----------------------------------------------------------------

def attach_task(rollouts: DataFrame, tasks: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Each completion with its task (inner equi-join on the prompt key)."""
    return rollouts.join(tasks, key, "inner")


def merge_model_scores(rewards: DataFrame, scores: DataFrame, key: str, score_col: str = "score",
                       reward_col: str = "reward", bound: float = 3.0) -> DataFrame:
    """Add an external score clipped to [-bound, bound]; missing -> 0."""
    s = scores.select(key, F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col(score_col))).alias("_s"))
    return (rewards.join(s, key, "left")
            .withColumn(reward_col, F.col(reward_col) + F.coalesce(F.col("_s"), F.lit(0.0))).drop("_s"))


def fan_out(prompts: DataFrame, n: int, col: str = "gen_id") -> DataFrame:
    """Each prompt repeated n times (gen 0..n-1)."""
    return prompts.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


# ---- A6 / A7 ------------------------------------------------------------------------

def clip(x: Column, bound: float = 3.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def agent_reward(df: DataFrame, completion: str = "completion", tools: str = "tools", gt: str = "gt",
                 unfinished: str = "unfinished", score: str | None = None, turns: str | None = None) -> DataFrame:
    """A6 over rollouts already joined with their task (J2): adds n_calls, n_valid, n_matched, reward.

    ``turns`` names the outputs of a rollout's turns (without it the completion is the one turn): calls and tag
    penalties are summed over all of them, the last turn's answer is the answer."""
    resp = F.col(completion)
    answers = F.transform(F.col(turns) if turns else F.array(resp), lambda t: split_think(t)[2])
    df = df.withColumn("_turns", answers).withColumn("_answer", F.coalesce(F.try_element_at("_turns", F.lit(-1)), py_strip(resp)))
    df = df.withColumn("_calls", F.flatten(F.transform("_turns", extract_tool_calls)))
    n_calls = F.size("_calls")
    tag = tag_imbalance("_turns")
    # no tool call: format + optional external score - repetition of what follows the reasoning
    has, _, after = split_think(resp)
    plain_answer = F.when(has, after).otherwise(F.col("_answer"))
    plain = tag + format_score(resp, lo=5) - rep_penalty(plain_answer)
    if score is not None:
        plain = plain + F.coalesce(F.col(score), F.lit(0.0))
    # tool calls: alignment + ground truth - unfinished - repetition
    unf = F.coalesce(F.col(unfinished), F.lit(False))
    after_last = F.when(F.instr(F.col("_answer"), "</tool_call>") > 0,
                        F.element_at(F.split("_answer", "</tool_call>"), -1)).otherwise(F.col("_answer"))
    final_text = F.when(unf, F.lit("")).otherwise(after_last)
    df = df.withColumn("_final", final_text)
    n_valid = valid_tool_calls("_calls", tools)
    n_gt = F.coalesce(F.size(gt), F.lit(0))
    matched = match_ground_truth("_final", gt)
    df = df.withColumn("n_calls", n_calls).withColumn("n_valid", n_valid) \
           .withColumn("n_matched", F.when(F.col("n_calls") > 0, matched).otherwise(F.lit(0)))
    gt_term = F.when(n_gt > 0, F.lit(2.5) * F.col("n_matched") / n_gt).otherwise(F.lit(0.0))
    rep_text = F.when(F.length("_final") > 0, F.col("_final")).otherwise(F.col("_answer"))
    with_calls = (tag + tool_gap("n_valid", "n_calls", n_gt) + gt_term
                  - F.when(unf, F.lit(0.5)).otherwise(F.lit(0.0)) - rep_penalty(rep_text))
    reward = clip(F.when(F.col("n_calls") > 0, with_calls).otherwise(plain))
    return df.withColumn("reward", reward).drop("_turns", "_answer", "_calls", "_final")


def chat_reward(df: DataFrame, completion: str = "completion", score: str | None = None) -> DataFrame:
    """Format score (lo=20) - repetition of the answer + external score; no total clip."""
    _, _, answer = split_think(completion)
    r = format_score(completion, lo=20) - rep_penalty(answer)
    if score is not None:
        r = r + F.coalesce(F.col(score), F.lit(0.0))
    return df.withColumn("reward", r)


# ---- P13 / P14 ---------------------------------------------------------------------

def parse_chatml(prompt) -> Column:
    """``array<struct<role, content>>`` of the system/user/assistant blocks; content stripped."""
    p = _c(prompt)
    pat = r"(?s)<\|im_start\|>(system|user|assistant)\s+(.*?)<\|im_end\|>"
    roles = F.regexp_extract_all(p, F.lit(pat), 1)
    contents = F.regexp_extract_all(p, F.lit(pat), 2)
    return F.zip_with(roles, contents, lambda r, c: F.struct(r.alias("role"), py_strip(c).alias("content")))


def reward_context(messages, join: str = HISTORY_JOIN) -> Column:
    """``role: content`` of all but the last message joined by newlines, then ``join`` and the last
    content; without history just the last content; no messages -> ''."""
    m = _c(messages)
    n = F.size(m)
    hist = F.array_join(F.transform(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))),
                                    lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    last = F.try_element_at(m, F.lit(-1))["content"]
    return (F.when(n == 0, F.lit(""))
            .when(F.length(hist) > 0, F.concat(hist, F.lit(join), F.coalesce(last, F.lit(""))))
            .otherwise(F.coalesce(last, F.lit(""))))
