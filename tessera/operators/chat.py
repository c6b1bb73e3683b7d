"""Chat shaping (P1-P20): Column -> Column expressions over ``array<struct<role, content, ...>>``.

Everything is a native Spark expression (higher-order functions stay in the JVM) except the JSON
re-serialisation the chat template needs for tool schemas and dict arguments: Spark's ``to_json``
is compact while the template writes ``json.dumps`` spacing, so that part is one small
Arrow-batched UDF applied only to the ``tools`` / ``tool_calls`` text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rand import keyed_uniform
from tessera.functions.text import py_strip

# --- fixed values ---------------------------------------------------------------
# Prompts that name no product; a job with prompts of its own passes them.
SYSTEM_PROMPTS = [
    "你是一个知识丰富的AI，尽力为用户提供准确的信息。",
    "你是一个专业的AI助手，请提供有价值的回答。",
    "你是一个可靠的AI，请给出准确的回答。",
    "You are a helpful AI assistant.",
    "You are a friendly chatbot. Please answer the user's questions carefully.",
    "You are a knowledgeable AI. Try your best to provide accurate information.",
]
EMPTY_THINK = "<think>\n\n</think>\n\n"
TOOLS_INTRO = ("# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
               "You are provided with function signatures within <tools></tools> XML tags:\n<tools>")
TOOLS_OUTRO = ("\n</tools>\n\nFor each function call, return a json object with function name and arguments "
               "within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, "
               "\"arguments\": <args-json-object>}\n</tool_call><|im_end|>\n")
CHATML_PATTERN = r"(?s)<\|im_start\|>(system|user|assistant)\s+(.*?)<\|im_end\|>"
# ---------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- P1 / P2 -------------------------------------------------------------------

def parse_json_fields(conv, schema) -> Column:
    """A conversation column that may be JSON text becomes the declared array type."""
    return F.from_json(_c(conv), schema)


def extract_tools(conv) -> Column:
    """P2 (text/agent): ``tools`` of the last system message whose ``tools`` is non-empty, else null."""
    with_tools = F.filter(_c(conv), lambda m: (m["role"] == "system") & (F.length(m["tools"]) > 0))
    return F.try_element_at(with_tools, F.lit(-1))["tools"]


def extract_vision_functions(conv) -> Column:
    """P2 (vision): ``functions`` of the first message if it is a system message."""
    first = F.try_element_at(_c(conv), F.lit(1))
    return F.when(first["role"] == "system", first["functions"])


# ---- P3 / P4 / P5 / P6 -----------------------------------------------------------

MESSAGE_FIELDS = ("role", "content", "reasoning_content", "tools", "tool_calls")


def make_message(role: Column, content: Column, fields=MESSAGE_FIELDS) -> Column:
    """A message struct with the given string fields; all but role/content null."""
    vals = {"role": role, "content": content}
    return F.struct(*[vals.get(f, F.lit(None).cast("string")).alias(f) for f in fields])


def add_system_prompt(conv, key, ratio: float = 0.2, seed: int = 42, fields=MESSAGE_FIELDS, prompts=tuple(SYSTEM_PROMPTS)) -> Column:
    """Prepend one of ``prompts`` with probability ``ratio``.

    Skipped when any message carries tools or the first message is already a system message.
    Two keyed draws: ``sys`` decides, ``sysp`` picks the prompt uniformly.  An empty list passes through
    (the reference raises on it).
    """
    conv = _c(conv)
    has_tools = F.exists(conv, lambda m: F.coalesce(F.length(m["tools"]) > 0, F.lit(False)))
    first_role = F.try_element_at(conv, F.lit(1))["role"]
    u = keyed_uniform(key, "sys", seed)
    pick = (F.floor(keyed_uniform(key, "sysp", seed) * len(prompts)) + 1).cast("int")
    prompt = F.element_at(F.array(*[F.lit(p) for p in prompts]), pick)
    prepended = F.concat(F.array(make_message(F.lit("system"), prompt, fields)), conv)
    cond = (F.size(conv) > 0) & ~has_tools & (F.coalesce(first_role, F.lit("")) != "system") & (u < ratio)
    return F.when(cond, prepended).otherwise(conv)


def strip_empty_think(text, key, keep: float = 0.2, seed: int = 42, tag: str = "think") -> Column:
    """With probability 1-keep remove every ``<think>\\n\\n</think>\\n\\n`` from the rendered text.

    Written so the text is referenced once (replacing the block by itself when kept): a text expression
    repeated under a Python UDF's input trips subexpression elimination in Spark."""
    u = keyed_uniform(key, tag, seed)
    return F.replace(_c(text), F.lit(EMPTY_THINK), F.when(u > keep, F.lit("")).otherwise(F.lit(EMPTY_THINK)))


def drop_last_turn(conv) -> Column:
    """P5: all but the last message (empty stays empty)."""
    conv = _c(conv)
    return F.when(F.size(conv) <= 1, F.slice(conv, 1, 0)).otherwise(F.slice(conv, F.lit(1), F.size(conv) - 1))


def assign_thinking(key, ratio: float = 0.5, seed: int = 42) -> Column:
    """Bernoulli(ratio) per sample."""
    return keyed_uniform(key, "thinking", seed) < ratio


# ---- P7: chat template ----------------------------------------------------------

def _dumps(obj) -> str:
    return json.dumps(obj, ensure_ascii=False)


def _render_calls(raw) -> list[str] | None:
    """Rendered ``<tool_call>`` blocks of one message's ``tool_calls`` JSON text (template rule d)."""
    if raw is None:
        return None
    calls = json.loads(raw) if isinstance(raw, str) else raw
    if not calls:
        return None
    out = []
    for call in calls:
        if isinstance(call, dict) and call.get("function"):
            call = call["function"]
        args = call.get("arguments")
        args_text = args if isinstance(args, str) else _dumps(args)
        out.append('<tool_call>\n{"name": "' + str(call.get("name")) + '", "arguments": ' + args_text + "}\n</tool_call>")
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _tool_calls_blocks(tool_calls: pd.Series) -> pd.Series:
    return tool_calls.map(lambda arr: None if arr is None else [_render_calls(x) for x in arr])


@F.pandas_udf(T.StringType())
def _tools_lines(tools: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        items = json.loads(raw) if isinstance(raw, str) else raw
        if not items:
            return None
        return "".join("\n" + _dumps(t) for t in items)
    return tools.map(one)


def lstrip_nl(x: Column) -> Column:
    return F.regexp_replace(x, "^\n+", "")


def rstrip_nl(x: Column) -> Column:
    return F.regexp_replace(x, "\n+\\z", "")


def split_reasoning(content: Column, reasoning: Column) -> tuple[Column, Column]:
    """Template rule (c): (reasoning, content) of an assistant message."""
    has_rc = reasoning.isNotNull()
    has_end = F.instr(content, "</think>") > 0
    before = rstrip_nl(F.element_at(F.split(content, "</think>"), 1))
    rc_from_content = lstrip_nl(F.element_at(F.split(before, "<think>"), -1))
    rc = F.when(has_rc, reasoning).when(has_end, rc_from_content).otherwise(F.lit(""))
    after = lstrip_nl(F.element_at(F.split(content, "</think>"), -1))
    content2 = F.when(~has_rc & has_end, after).otherwise(content)
    return rc, content2


def _message(conv: Column, m: Column, i: Column, blocks: Column | None = None) -> Column:
    """One rendered message (rules b-e); ``i`` is 0-based; ``blocks`` = this message's tool-call blocks."""
    content = F.coalesce(m["content"], F.lit(""))
    rc, content2 = split_reasoning(content, m["reasoning_content"])
    if blocks is not None:
        calls = F.coalesce(F.array_join(F.transform(blocks, lambda t, k: F.concat(
            F.when((k > 0) | (F.length(content2) > 0), F.lit("\n")).otherwise(F.lit("")), t)), ""), F.lit(""))
    else:
        calls = F.lit("")
    assistant = F.concat(F.lit("<|im_start|>assistant\n<think>\n"), lstrip_nl(rstrip_nl(rc)),
                         F.lit("\n</think>\n\n"), lstrip_nl(content2), calls, F.lit("<|im_end|>\n"))
    prev_role = F.coalesce(F.try_element_at(conv, i)["role"], F.lit(""))
    next_role = F.coalesce(F.try_element_at(conv, i + 2)["role"], F.lit(""))
    tool = F.concat(
        F.when((i == 0) | (prev_role != "tool"), F.lit("<|im_start|>user")).otherwise(F.lit("")),
        F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
        F.when((i == F.size(conv) - 1) | (next_role != "tool"), F.lit("<|im_end|>\n")).otherwise(F.lit("")))
    plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), content, F.lit("<|im_end|>\n"))
    return (F.when((m["role"] == "user") | ((m["role"] == "system") & (i > 0)), plain)
            .when(m["role"] == "assistant", assistant)
            .when(m["role"] == "tool", tool)
            .otherwise(F.lit("")))


def render_chat(conv, tools=None, add_generation_prompt=False, open_thinking=False,
                tool_call_blocks: Column | None = None) -> Column:
    """The ChatML chat template (rules a-f of SURVEY §2.2) as one native expression.

    ``tools``: a JSON-text column (list of tool schemas) or None.  ``tool_call_blocks``: the per-message
    rendered tool calls (``tool_call_blocks(conv)``); None = no tool calls.
    ``add_generation_prompt`` and ``open_thinking`` may be bools or boolean Columns.
    """
    conv = _c(conv)
    if tool_call_blocks is None:
        body = F.array_join(F.transform(conv, lambda m, i: _message(conv, m, i)), "")
    else:
        # the blocks enter as an argument of the higher-order function (arrays_zip), never inside its
        # lambda: a Python UDF result folded into a lambda body cannot be evaluated
        zipped = F.arrays_zip(conv.alias("m"), tool_call_blocks.alias("b"))
        body = F.array_join(F.transform(zipped, lambda z, i: _message(conv, z["m"], i, z["b"])), "")
    first = F.try_element_at(conv, F.lit(1))
    first_is_system = F.coalesce(first["role"] == "system", F.lit(False))
    header = F.when(first_is_system, F.concat(F.lit("<|im_start|>system\n"), F.coalesce(first["content"], F.lit("")),
                                              F.lit("<|im_end|>\n"))).otherwise(F.lit(""))
    if tools is not None:
        lines = _tools_lines(_c(tools))
        tools_header = F.concat(
            F.lit("<|im_start|>system\n"),
            F.when(first_is_system, F.concat(F.coalesce(first["content"], F.lit("")), F.lit("\n\n")))
             .otherwise(F.lit("")),
            F.lit(TOOLS_INTRO), lines, F.lit(TOOLS_OUTRO))
        header = F.when(lines.isNotNull(), tools_header).otherwise(header)
    gen = F.concat(F.lit("<|im_start|>assistant\n"),
                   F.when(_as_col(open_thinking), F.lit("<think>\n")).otherwise(F.lit(EMPTY_THINK)))
    gen = F.when(_as_col(add_generation_prompt), gen).otherwise(F.lit(""))
    return F.concat(header, F.coalesce(body, F.lit("")), gen)


def tool_call_blocks(conv) -> Column:
    """Per message, the rendered ``<tool_call>`` blocks (Arrow-batched UDF over the JSON text)."""
    return _tool_calls_blocks(F.transform(_c(conv), lambda m: m["tool_calls"]))


def with_rendered_chat(df, conv: str, out: str = "text", tools=None, add_generation_prompt=False,
                       open_thinking=False, tool_calls: bool = True):
    """DataFrame form of P7; set ``tool_calls=False`` for inputs known to carry none (skips the UDF)."""
    blocks = tool_call_blocks(conv) if tool_calls else None
    return df.withColumn(out, render_chat(conv, tools, add_generation_prompt, open_thinking, blocks))


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(bool(x))


# ---- P8 / P9 / P10: media placeholders --------------------------------------------

def expand_image_placeholder(conv, n: int = 64, fields=MESSAGE_FIELDS) -> Column:
    """``<image>`` -> ``<|image_pad|>`` x n in every non-system message."""
    pads = "<|image_pad|>" * n
    return F.transform(_c(conv), lambda m: F.when(
        m["role"] != "system", m.withField("content", F.replace(m["content"], F.lit("<image>"), F.lit(pads))))
        .otherwise(m))


def place_image_tag(content, key, seed: int = 42) -> Column:
    """In a text that holds ``<image>``, remove every one, strip, then put one back: u<0.2 front+\\n;
    <0.4 front+\\n\\n; <0.6 back after \\n; else back after \\n\\n.  Other texts stay."""
    text = _c(content)
    c = py_strip(F.replace(_c(content), F.lit("<image>"), F.lit("")))
    u = keyed_uniform(key, "imgtag", seed)
    return (F.when(~F.contains(text, F.lit("<image>")), text)
            .when(u < 0.2, F.concat(F.lit("<image>\n"), c))
            .when(u < 0.4, F.concat(F.lit("<image>\n\n"), c))
            .when(u < 0.6, F.concat(c, F.lit("\n<image>")))
            .otherwise(F.concat(c, F.lit("\n\n<image>"))))


def insert_audio_placeholder(conv, n_frames, key, seed: int = 42) -> Column:
    """P10: in the last user message only, when n_frames > 0, with ap = ``<|audio_pad|>`` x n:
    u<0.4 replace the text; <0.6 leave; <0.8 ``ap\\n\\ntext``; else ``text\\n\\nap``."""
    conv = _c(conv)
    nf = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    ap = F.repeat(F.lit("<|audio_pad|>"), nf)
    u = keyed_uniform(key, "audiotag", seed)
    last_user = F.array_max(F.transform(conv, lambda m, i: F.when(m["role"] == "user", i)))

    def put(m, i):
        t = F.coalesce(m["content"], F.lit(""))
        new = (F.when(u < 0.4, ap).when(u < 0.6, t)
               .when(u < 0.8, F.concat(ap, F.lit("\n\n"), t)).otherwise(F.concat(t, F.lit("\n\n"), ap)))
        return F.when((i == last_user) & (nf > 0), m.withField("content", new)).otherwise(m)

    return F.transform(conv, put)


# ---- P11: cut a multi-turn conversation at a random assistant turn that fits ---------

def truncate_to_turn(conv, key, max_len: int, reserve: int = 100, seed: int = 42) -> Column:
    """With more than one assistant message, pick one uniformly and cut after it; while the rendered
    prefix needs ``tokens + reserve >= max_len`` step back to the previous assistant message; if none fits,
    keep the cut after the first assistant message.  Token counts use the byte vocabulary; a prefix's
    count is the header plus its messages' pieces (pieces do not depend on later messages when the cut
    ends on an assistant message)."""
    from tessera.operators.tokenizer import byte_token_count
    conv = _c(conv)
    first = F.try_element_at(conv, F.lit(1))
    first_is_system = F.coalesce(first["role"] == "system", F.lit(False))
    header = F.when(first_is_system, byte_token_count(F.concat(
        F.lit("<|im_start|>system\n"), F.coalesce(first["content"], F.lit("")), F.lit("<|im_end|>\n")))).otherwise(0)
    piece_n = F.transform(conv, lambda m, i: byte_token_count(_message(conv, m, i)))
    asst = F.filter(F.transform(conv, lambda m, i: F.when(m["role"] == "assistant", i)), lambda x: x.isNotNull())
    n_asst = F.size(asst)
    pick = F.floor(keyed_uniform(key, "turncut", seed) * n_asst).cast("int")   # 0-based among assistants

    def choose(st):
        # st = struct(pieces, asst, pick, header)
        prefix = lambda idx: st["header"] + F.aggregate(F.slice(st["pieces"], 1, idx + 1), F.lit(0).cast("long"),
                                                        lambda a, x: a + x)
        fits = F.filter(F.slice(st["asst"], 1, st["pick"] + 1), lambda idx: prefix(idx) + reserve < max_len)
        return F.coalesce(F.array_max(fits), F.element_at(st["asst"], 1))

    from tessera.functions.arrays import let
    st = F.struct(piece_n.alias("pieces"), asst.alias("asst"), pick.alias("pick"), header.cast("long").alias("header"))
    cut = let(st, choose)
    return F.when(n_asst > 1, F.slice(conv, 1, cut + 1)).otherwise(conv)


# ---- P19 / P20 ------------------------------------------------------------------------

CLONE_VOICE = "voice_clone"   # fixed value: the name used when none is given


def validate_voice_names(names, registry, name: str = "name", max_len: int = 24):
    """Normalise (collapse whitespace; empty -> ``voice_clone``) and give a reject reason:
    ``too_long`` (> 24 chars), ``reserved`` (``default`` in any case), ``taken`` (already in the registry's
    builtin or unseen groups) or null when accepted.  ``registry``: (name, grp)."""
    from tessera.functions.text import PY_SPACE_CLASS
    norm = F.btrim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "[" + PY_SPACE_CLASS + "]+", " "), F.lit(" "))
    norm = F.when(F.length(norm) == 0, F.lit(CLONE_VOICE)).otherwise(norm)
    taken = registry.filter(F.col("grp").isin("builtin", "unseen")).select(F.col("name").alias("_n")).distinct() \
        .withColumn("_taken", F.lit(True))
    df = names.withColumn("voice", norm)
    df = df.join(taken, df["voice"] == taken["_n"], "left").drop("_n")
    reason = (F.when(F.length("voice") > max_len, F.lit("too_long"))
              .when(F.lower("voice") == "default", F.lit("reserved"))
              .when(F.coalesce("_taken", F.lit(False)), F.lit("taken")))
    return df.withColumn("reject", reason).drop("_taken")


def build_eval_prompts(text, weight_name: str = "", langs=None, open_thinking: bool = False) -> Column:
    """P20: weights whose name contains ``pretrain`` get ``<|im_start|>`` + raw prompt; otherwise the chat
    template with a generation prompt around one user message.  ``langs`` fans each prompt out per language
    (returned as an array to explode)."""
    t = _c(text)
    if "pretrain" in weight_name:
        p = F.concat(F.lit("<|im_start|>"), t)
    else:
        conv = F.array(make_message(F.lit("user"), t))
        p = render_chat(conv, add_generation_prompt=True, open_thinking=open_thinking)
    return p if not langs else F.transform(F.array(*[F.lit(x) for x in langs]),
                                           lambda lang: F.struct(lang.alias("lang"), p.alias("prompt")))


def media_prompt(text, audio_frames=None, image_pads=None) -> Column:
    """P20: a prompt of text and media: the text, the audio's pads right after it (one at least), then a blank line and the image's
    pads.  Null ``audio_frames`` or ``image_pads`` mean no audio or image; an image alone has no blank line before it."""
    from tessera.functions.arrays import let
    none = F.lit(None).cast("int")
    frames = none if audio_frames is None else _c(audio_frames).cast("int")
    pads = none if image_pads is None else _c(image_pads).cast("int")
    head = F.concat(F.coalesce(_c(text), F.lit("")), F.when(frames.isNotNull(), F.repeat(F.lit("<|audio_pad|>"), F.greatest(F.coalesce(frames, F.lit(1)), F.lit(1)))).otherwise(F.lit("")))
    gap = lambda h: F.when(F.length(h) > 0, F.lit("\n\n")).otherwise(F.lit(""))
    return let(head, lambda h: F.when(pads.isNull(), h).otherwise(F.concat(h, gap(h), F.repeat(F.lit("<|image_pad|>"), F.coalesce(pads, F.lit(0))))))
