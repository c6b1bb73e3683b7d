import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import lookups, udf
from tessera.sources import (scan_agent_jsonl, scan_media_dir, scan_pretrain_jsonl, scan_preference_jsonl,
                             scan_rlaif_jsonl, scan_sft_jsonl, scan_speech_parquet, scan_tokenizer_corpus,
                             write_training_table)
from tessera.sources.sinks import load_roles, load_tokenizer, save_tokenizer


def _write(lines):
    d = tempfile.mkdtemp(prefix="tessera-src-", dir="/tmp")
    p = os.path.join(d, "x.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_jsonl_scans(spark):
    p = _write([json.dumps({"text": "a"}), json.dumps({"text": None}), json.dumps({"text": "b"})])
    assert [r.text for r in scan_pretrain_jsonl(spark, p).orderBy("sample_id").collect()] == ["a", "b"]
    conv = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "tools": None}]
    p = _write([json.dumps({"conversations": conv})])
    r = scan_sft_jsonl(spark, p).first()
    assert r.conversations[1].content == "yo" and r.conversations[0].reasoning_content is None and r.sample_id == 0
    p = _write([json.dumps({"chosen": conv, "rejected": conv[:1]})])
    assert len(scan_preference_jsonl(spark, p).first().rejected) == 1
    p = _write([json.dumps({"conversations": conv})])
    assert scan_rlaif_jsonl(spark, p).first().conversations[0].role == "user"


def test_agent_scan_is_strict(spark):
    p = _write([json.dumps({"conversations": [], "gt": ["1"]}), "{broken"])
    with pytest.raises(Exception):
        scan_agent_jsonl(spark, p).collect()


def test_tokenizer_corpus_counts_bad_lines(spark):
    conv = lambda *c: json.dumps({"conversations": [{"role": "user", "content": x} for x in c]})
    p = _write([conv("a", "b"), "{bad", conv(""), conv("c"), conv("d")])
    got = [r.text for r in scan_tokenizer_corpus(spark, p, max_lines=4).orderBy("line_no").collect()]
    assert got == ["a\nb", "c"]


def test_speech_shards_union_and_defaults(spark):
    d = tempfile.mkdtemp(prefix="tessera-spq-", dir="/tmp")
    a, b = os.path.join(d, "a"), os.path.join(d, "b")
    spark.createDataFrame([("[]", [1, 2])], "conversations string, ref_audios array<int>").write.parquet(a)
    spark.createDataFrame([("[]",), ("[]",)], "conversations string").write.parquet(b)
    df = scan_speech_parquet(spark, f"{a},{b}", max_samples=2)
    rows = df.orderBy("sample_id").collect()
    assert len(rows) == 2 and rows[0].ref_audios == [1, 2] and rows[1].ref_audios == [] and rows[1].spk_emb == []


def test_media_dir(spark):
    d = tempfile.mkdtemp(prefix="tessera-media-", dir="/tmp")
    for n in ["img_b.PNG", "img_a.png", "other.png", "img_c.txt"]:
        with open(os.path.join(d, n), "wb") as f:
            f.write(n.encode())
    got = [r.name for r in scan_media_dir(spark, d, "img_", (".png",)).collect()]
    assert got == ["img_a.png", "img_b.PNG"]


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tessera-sink-", dir="/tmp")
    df = spark.createDataFrame([(1, [1, 2])], "k long, ids array<int>")
    write_training_table(df, os.path.join(d, "t"), mode="overwrite")
    assert spark.read.parquet(os.path.join(d, "t")).first().ids == [1, 2]
    vocab = spark.createDataFrame([(0, "<|endoftext|>", True)], "id int, token string, special boolean")
    merges = spark.createDataFrame([(0, 36, 37, 292)], "rank int, left int, right int, id int")
    save_tokenizer(vocab, merges, os.path.join(d, "tok"))
    v, m = load_tokenizer(spark, os.path.join(d, "tok"))
    assert v.count() == 1 and m.first().id == 292


def test_tokenizer_roles(spark):
    from tessera.functions.tokens import ROLE_TOKENS, SPECIAL_TOKENS, TOKEN_ID
    from tessera.operators.tokenizer import special_token_table
    d = os.path.join(tempfile.mkdtemp(prefix="tessera-roles-", dir="/tmp"), "tok")
    merges = spark.createDataFrame([(1, 40, 41, 293), (0, 36, 37, 292)], "rank int, left int, right int, id int")
    for _ in range(2):  # a second save takes the place of the first
        save_tokenizer(special_token_table(spark), merges, d)
    vocab, saved = load_tokenizer(spark, d)
    assert vocab.columns == ["id", "token", "special"] and vocab.count() == 36 and saved.count() == 2
    assert {r.token for r in vocab.where("special").collect()} == set(SPECIAL_TOKENS)
    roles = load_roles(spark, d).collect()
    assert all(r.id == TOKEN_ID[r.token] for r in roles)
    assert {r.role: r.token for r in roles if r.role in ROLE_TOKENS} == ROLE_TOKENS
    assert sorted(r.id for r in roles if r.role not in ROLE_TOKENS) == list(range(1, len(SPECIAL_TOKENS)))
    lines = [json.loads(r.value) for r in spark.read.text(f"{d}/merges_json").collect()]
    assert [x["id"] for x in lines] == [292, 293]
    # a vocabulary without some role's token
    save_tokenizer(spark.createDataFrame([(7, "<|im_end|>", True)], "id int, token string, special boolean"), merges, d)
    ids = {r.role: r.id for r in load_roles(spark, d).collect()}
    assert ids["eos_token"] == 7 and ids["pad_token"] is None


def test_user_hooks(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 10)], "k long, t string")
    s = udf.score_with(df, lambda p: p["t"].str.len() - 5.0, ["t"]).orderBy("k").collect()
    assert [r.score for r in s] == [-2.0, 3.0]
    gen = udf.generate_with(df, lambda p: pd.DataFrame({"k": p["k"], "completion": p["t"] + "!"}),
                            T.StructType([T.StructField("k", T.LongType()), T.StructField("completion", T.StringType())]))
    assert sorted(r.completion for r in gen.collect()) == ["abc!", "xxxxxxxxxx!"]
    m = df.select(udf.process_media("t", lambda x: x.str.upper(), T.StringType()).alias("u")).collect()
    assert sorted(r.u for r in m) == ["ABC", "XXXXXXXXXX"]


def test_registry_ties_and_repeated_deletes(spark):
    schema = "name string, grp string, voice string"
    reg = spark.createDataFrame([("a", "builtin", "v2"), ("a", "builtin", "v1"), ("m", "manual", "v1"), (None, "manual", "v0")], schema)
    upd = spark.createDataFrame([("a", "builtin", "v0"), ("m", "builtin", "v3"), ("u", "unseen", "v5")], schema)
    gone = spark.createDataFrame([("m",), ("m",), ("a",), (None,)], "name string")
    for parts in (1, 7):  # the same row of a tie under any partitioning
        out = lookups.registry_upsert(reg.repartition(parts), upd)
        assert out.columns == reg.columns
        assert {tuple(r) for r in out.collect()} == {("a", "builtin", "v1"), ("m", "manual", "v1"), ("u", "unseen", "v5"), (None, "manual", "v0")}
        left = lookups.registry_upsert(reg.repartition(parts), upd, deletes=gone)
        # a null name equals no delete
        assert {tuple(r) for r in left.collect()} == {("a", "builtin", "v1"), ("u", "unseen", "v5"), (None, "manual", "v0")}


def test_registry_upsert_and_media_pairs(spark):
    reg = spark.createDataFrame([("a", "builtin"), ("b", "unseen"), ("m", "manual")], "name string, grp string")
    upd = spark.createDataFrame([("a", "manual"), ("b", "builtin"), ("n", "manual")], "name string, grp string")
    dele = spark.createDataFrame([("m",), ("b",)], "name string")
    out = {r.name: r.grp for r in lookups.registry_upsert(reg, upd, deletes=dele).collect()}
    assert out == {"a": "manual", "b": "builtin", "n": "manual"}
    runs = spark.createDataFrame([(1, 0), (1, 1)], "sample_id long, k long")
    media = spark.createDataFrame([(1, 0, "img")], "sample_id long, k long, item string")
    assert lookups.pair_media_runs(runs, media).filter(F.col("item").isNull()).count() == 1


def test_vision_scan_and_tool_extraction(spark):
    from tessera.operators.chat import extract_tools, parse_json_fields
    from tessera.sources import scan_vision_parquet
    from tessera.sources.schemas import CONVERSATION
    d = tempfile.mkdtemp(prefix="tessera-vis-", dir="/tmp")
    conv = json.dumps([{"role": "system", "content": "s", "tools": "[{\"a\": 1}]"},
                       {"role": "system", "content": "s2", "tools": ""},
                       {"role": "user", "content": "<image> hi"}])
    spark.createDataFrame([(conv, b"img", 1), (conv, b"img2", 2)], "conversations string, image_bytes binary, extra int") \
        .coalesce(1).write.parquet(os.path.join(d, "v"))
    df = scan_vision_parquet(spark, os.path.join(d, "v"), max_samples=1, columns=["conversations", "image_bytes"])
    r = df.first()
    assert df.count() == 1 and r.image_bytes == [bytearray(b"img")] and r.conversations[2].content == "<image> hi"
    assert "extra" not in df.columns
    t = spark.createDataFrame([(conv,)], "c string").select(parse_json_fields("c", CONVERSATION).alias("c"))
    assert t.select(extract_tools("c").alias("t")).first().t == "[{\"a\": 1}]"
