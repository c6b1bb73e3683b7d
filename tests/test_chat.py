import json

from pyspark.sql import functions as F

from tessera.operators.chat import (add_system_prompt, drop_last_turn, expand_image_placeholder,
                                    insert_audio_placeholder, strip_empty_think, with_rendered_chat)
from tessera.sources.schemas import SFT


def _conv(spark, rows):
    df = spark.createDataFrame([(i, json.dumps({"conversations": r})) for i, r in enumerate(rows)], "k long, v string")
    return df.select("k", F.from_json("v", SFT)["conversations"].alias("conversations"))


def _render(spark, rows, **kw):
    df = with_rendered_chat(_conv(spark, rows), "conversations", "r", **kw)
    return [r.r for r in df.orderBy("k").collect()]


def test_assistant_reasoning_variants(spark):
    out = _render(spark, [[
        {"role": "user", "content": "q"},
        {"role": "assistant", "content": "<think>\nr1\n</think>\n\nans"},
        {"role": "assistant", "content": "a2", "reasoning_content": ""},
        {"role": "assistant", "content": "x</think>y</think>\n\nz"},
        {"role": "assistant", "content": "\n\nplain"},
    ]])
    assert out[0] == ("<|im_start|>user\nq<|im_end|>\n"
                      "<|im_start|>assistant\n<think>\nr1\n</think>\n\nans<|im_end|>\n"
                      "<|im_start|>assistant\n<think>\n\n</think>\n\na2<|im_end|>\n"
                      "<|im_start|>assistant\n<think>\nx\n</think>\n\nz<|im_end|>\n"
                      "<|im_start|>assistant\n<think>\n\n</think>\n\nplain<|im_end|>\n")


def test_system_first_and_middle_and_tools_envelope(spark):
    out = _render(spark, [[
        {"role": "system", "content": "S"}, {"role": "user", "content": "u"},
        {"role": "system", "content": "mid"},
        {"role": "tool", "content": "r1"}, {"role": "tool", "content": "r2"}, {"role": "user", "content": "u2"},
    ]], add_generation_prompt=True, open_thinking=True)
    assert out[0] == ("<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
                      "<|im_start|>system\nmid<|im_end|>\n"
                      "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response>"
                      "<|im_end|>\n<|im_start|>user\nu2<|im_end|>\n<|im_start|>assistant\n<think>\n")


def test_tool_calls_string_and_object_arguments(spark):
    calls = [{"type": "function", "function": {"name": "f", "arguments": {"a": 1, "b": "中"}}},
             {"name": "g", "arguments": "{\"x\": 2}"}]
    out = _render(spark, [[{"role": "assistant", "content": "", "tool_calls": json.dumps(calls)},
                           {"role": "assistant", "content": "c", "tool_calls": json.dumps(calls[1:])}]])
    assert out[0] == ("<|im_start|>assistant\n<think>\n\n</think>\n\n"
                      "<tool_call>\n{\"name\": \"f\", \"arguments\": {\"a\": 1, \"b\": \"中\"}}\n</tool_call>\n"
                      "<tool_call>\n{\"name\": \"g\", \"arguments\": {\"x\": 2}}\n</tool_call><|im_end|>\n"
                      "<|im_start|>assistant\n<think>\n\n</think>\n\nc\n"
                      "<tool_call>\n{\"name\": \"g\", \"arguments\": {\"x\": 2}}\n</tool_call><|im_end|>\n")


def test_tools_header(spark):
    tools = json.dumps([{"type": "function", "function": {"name": "f"}}])
    df = _conv(spark, [[{"role": "system", "content": "sys", "tools": tools}, {"role": "user", "content": "u"}]])
    r = with_rendered_chat(df, "conversations", "r", tools=F.col("conversations")[0]["tools"]).first().r
    assert r.startswith("<|im_start|>system\nsys\n\n# Tools\n")
    assert "<tools>\n{\"type\": \"function\", \"function\": {\"name\": \"f\"}}\n</tools>" in r
    assert r.endswith("</tool_call><|im_end|>\n<|im_start|>user\nu<|im_end|>\n")


def test_system_prompt_and_empty_think_are_keyed_and_skip_rules(spark):
    rows = [[{"role": "user", "content": "u"}]] * 50 + [[{"role": "system", "content": "s"}]] + \
           [[{"role": "user", "content": "u", "tools": "[1]"}]]
    df = _conv(spark, rows).withColumn("c2", add_system_prompt("conversations", "k"))
    got = {r.k: r.c2 for r in df.collect()}
    added = [k for k in range(50) if len(got[k]) == 2]
    assert 0 < len(added) < 50                       # about 20 %
    assert len(got[50]) == 1 and len(got[51]) == 1   # existing system / tools: untouched
    again = {r.k: r.c2 for r in df.collect()}
    assert got == again                              # same row, same draw
    t = spark.createDataFrame([(i, "a<think>\n\n</think>\n\nb<think>\n\n</think>\n\n") for i in range(40)], "k long, t string")
    s = [r.s for r in t.select(strip_empty_think("t", "k").alias("s")).collect()]
    assert set(s) == {"ab", "a<think>\n\n</think>\n\nb<think>\n\n</think>\n\n"}


def test_drop_last_turn_and_placeholders(spark):
    df = _conv(spark, [[{"role": "user", "content": "a <image> b"}, {"role": "assistant", "content": "x"},
                        {"role": "user", "content": "c"}], []])
    rows = df.select("k", drop_last_turn("conversations").alias("p"),
                     expand_image_placeholder("conversations", 2).alias("e"),
                     insert_audio_placeholder("conversations", 3, "k").alias("a")).orderBy("k").collect()
    assert len(rows[0].p) == 2 and rows[1].p == []
    assert rows[0].e[0].content == "a <|image_pad|><|image_pad|> b"
    last_user = rows[0].a[2].content
    assert "<|audio_pad|>" * 3 in last_user or last_user == "c"
    assert rows[0].a[0].content == "a <image> b"


def test_sft_dataset_job(spark):
    import os
    import tempfile

    from tessera.plans.sft import build_sft_dataset
    d = tempfile.mkdtemp(prefix="tessera-sft-", dir="/tmp")
    p = os.path.join(d, "sft.jsonl")
    tools = json.dumps([{"type": "function", "function": {"name": "f"}}])
    with open(p, "w", encoding="utf-8") as f:
        for i in range(40):
            conv = [{"role": "user", "content": f"question {i}"}, {"role": "assistant", "content": f"answer {i}"}]
            if i % 10 == 0:
                conv.insert(0, {"role": "system", "content": "s", "tools": tools})
            f.write(json.dumps({"conversations": conv}) + "\n")
    out = build_sft_dataset(spark, p, os.path.join(d, "out"), max_len=1024, batch_size=8, skip_batches=1)
    rows = spark.read.parquet(os.path.join(d, "out")).collect()
    assert len(rows) == 32 and sorted({r.batch_id for r in rows}) == [0, 1, 2, 3]
    assert all(len(r.input_ids) == 1024 and len(r.labels) == 1024 for r in rows)
    assert all(any(x != -100 for x in r.labels) for r in rows)
    assert out.count() == 32
