"""Hand-worked cases of the small operators that no registered query runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import audio, chat, lookups, ordering, rewards, sequences, tokenizer, udf
from tessera.sources import scan_sft_jsonl, scan_tokenizer_corpus
from tessera.sources.schemas import VISION_CONVERSATION
from tessera.sources.tables import with_file_order


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_skip_think_prefix_stays_in_its_span(spark):
    ids = ints(5, 5, 7, 8, 9, 5, 7, 8, 9, 1)
    r = one(spark, sequences.skip_think_prefix(ids, 1, [7, 8, 9]).alias("a"), sequences.skip_think_prefix(ids, 4, [7, 8, 9]).alias("b"),
            sequences.skip_think_prefix(ids, 4, [7, 8, 9], end=7).alias("c"), sequences.skip_think_prefix(ids, 1, [7, 8, 9], window=2).alias("d"),
            sequences.skip_think_prefix(ids, 11, [7]).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (6, 10, 4, 1, 11)


def test_tool_results(spark):
    texts = ['{"a": 1}', "{}", "[]", "null", "", None, '"x"', "0", "y" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.orderBy("i").select(rewards.tool_result_text("t").alias("r")).collect()]
    missing = '{"error": "tool not found"}'
    assert got == ['{"a": 1}', missing, missing, missing, missing, missing, '"x"', missing, "y" * 2048]


def test_strip_think(spark):
    df = spark.createDataFrame([(0, "<think> a </think> b <think>c</think>d "), (1, " r</think> x "), (2, "  plain ")], "i int, t string")
    content, reasoning = rewards.strip_think_api("t")
    rows = df.orderBy("i").select(content.alias("c"), reasoning.alias("r")).collect()
    assert [(r.c, r.r) for r in rows] == [("b d", "a"), ("x", "r"), ("plain", None)]


def test_argument_truth_keeps_json_types(spark):
    args = ['{"expression": "0"}', '{"expression": "false"}', '{"expression": 0}', '{"expression": false}', '{"expression": ""}', '{"expression": []}',
            '{"expression": [0]}', '{"expression": null}', "{}", "broken", None, '{"expression": 0.5}', '{"expression": {}}']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(args)], "i int, arguments string")
    call = F.struct(F.lit("calculate_math").alias("name"), F.col("arguments"))
    got = [r.v for r in df.orderBy("i").select(rewards.call_is_valid(call, ints("calculate_math")).alias("v")).collect()]
    assert got == [True, True, False, False, False, False, True, False, False, False, False, True, False]
    udf.register_arg_predicate("own", lambda a: a.truthy("x"))
    try:
        c = F.struct(F.lit("own").alias("name"), F.lit('{"x": 1}').alias("arguments"))
        assert one(spark, rewards.call_is_valid(c, ints("own")).alias("v")).v
    finally:
        rewards.ARG_PREDICATES.pop("own")


def test_pack_drop_fan_out(spark):
    ids, mask, logp = sequences.pack_prompt_response(ints(1, 2, 3), ints(4, 5), ints(1, 0), ints(-0.5, -0.25), max_total=4)
    r = one(spark, ids.alias("i"), mask.alias("m"), logp.alias("l"))
    assert (r.i, r.m, r.l) == ([2, 3, 4, 5], [0, 0, 1, 0], [0.0, -0.5, -0.25])
    kept, lps = sequences.drop_special_pairs(ints(7, 0, 2, 9), ints(-1.0, -2.0, -3.0, -4.0))
    r = one(spark, kept.alias("i"), lps.alias("l"))
    assert (r.i, r.l) == ([7, 9], [-1.0, -4.0])
    assert [r.gen_id for r in rewards.fan_out(spark.range(1), 3).collect()] == [0, 1, 2]


def test_every_rank_gets_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, x string")
    rows = sorted((r.shard, r.local_pos, r.x) for r in ordering.shard_by_rank(df, 5).collect())
    assert rows == [(0, 0, "a"), (1, 0, "b"), (2, 0, "a"), (3, 0, "b"), (4, 0, "a")]
    assert ordering.cap_samples(df, 1).count() == 1 and ordering.shard_by_rank(df.limit(0), 5).count() == 0


def test_lookups_and_their_defaults(spark):
    mk = spark.createDataFrame
    r = lookups.exchange_rate(mk([("USD", "CNY"), ("A", "B"), (None, "CNY")], "from_currency string, to_currency string"),
                              mk([("USD", "CNY", 7.0)], "from_currency string, to_currency string, rate double")).collect()
    assert sorted(x.rate for x in r) == [1.0, 1.0, 7.0]
    w = lookups.weather(mk([("here",), ("there",)], "location string"), mk([("here", "1", "sun")], "location string, temperature string, condition string"), "0", "fog")
    assert {(x.location, x.temperature, x.condition) for x in w.collect()} == {("here", "1", "sun"), ("there", "0", "fog")}
    t = lookups.current_time(mk([(None,), ("Z2",), ("Z1",)], "timezone string"), mk([("Z1", "one")], "timezone string, datetime string"), "Z1", "zero")
    assert sorted((x.timezone, x.datetime) for x in t.collect()) == [("Z1", "one"), ("Z1", "one"), ("Z2", "zero")]
    p = lookups.translate(mk([("hi", "fr"), ("yo", "fr")], "text string, target_language string"),
                          mk([("hi", "fr", "salut")], "text string, target_language string, translated_text string"))
    assert sorted(x.translated_text for x in p.collect()) == ["salut", "yo"]
    u = lookups.unit_convert(mk([(2.0, "KM", "Miles"), (3.0, "a", None)], "value double, from_unit string, to_unit string"),
                             mk([("km_miles", 0.621371)], "unit_key string, factor double"))
    assert sorted(x.result for x in u.collect()) == [1.2427, 3.0]


def test_vision_functions(spark):
    conv = json.dumps([{"role": "system", "content": "s", "functions": "[f]"}, {"role": "user", "content": "u"}])
    df = spark.createDataFrame([(conv,), (json.dumps([{"role": "user", "content": "u", "functions": "[g]"}]),)], "c string")
    got = df.select(chat.extract_vision_functions(chat.parse_json_fields("c", VISION_CONVERSATION)).alias("f")).collect()
    assert {r.f for r in got} == {"[f]", None}


def test_signal_edges_and_single_frames(spark):
    flat = spark.range(400).select("id", audio.augment_signal(F.array_repeat(F.lit(0.5), 9), "id").alias("a"),
                                   audio.mask_features(F.array_repeat(F.lit(1.0), 8), 8, "id", max_f=1).alias("m")).collect()
    still = [r for r in flat if max(r.a[3:6]) - min(r.a[3:6]) < 1e-12]      # rows without noise
    shrunk = [r.a for r in still if abs(r.a[0] - r.a[4]) > 1e-9]
    assert shrunk and all(r[0] < r[4] for r in shrunk)          # zeros beyond the edges
    assert all(sum(x == 0 for x in r.m) <= 1 for r in flat)     # one frame is never masked in time


def test_special_tokens_and_think_marks(spark):
    rows = tokenizer.special_token_table(spark).collect()
    assert len(rows) == 36 and sum(r.special for r in rows) == 21 and [r.id for r in rows] == list(range(36))


def write(folder, name, lines):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + b"\n")


def test_scans_number_in_file_order(spark, tmp_path):
    d = str(tmp_path)
    text = lambda x: json.dumps({"conversations": [{"role": "user", "content": x}]})
    write(d, "a.jsonl", [text("first"), text("second")])
    write(d, "b.jsonl", [text("x" * 500 + str(i)) for i in range(50)])
    rows = scan_sft_jsonl(spark, d).orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == list(range(52)) and rows[1].conversations[0].content == "second" and rows[2].conversations[0].content.endswith("x0")
    p = os.path.join(d, "parquet")
    spark.range(1000).repartition(7).write.parquet(p)
    numbered = with_file_order(spark.read.parquet(p)).collect()
    assert sorted(r.row_index for r in numbered) == list(range(1000))


def test_malformed_lines_fail_and_bytes_survive(spark, tmp_path):
    d = str(tmp_path)
    write(d, "bad.jsonl", [json.dumps({"conversations": []}), "{broken"])
    with pytest.raises(Exception):
        scan_sft_jsonl(spark, d).collect()
    e = str(tmp_path / "bytes")
    os.mkdir(e)
    msg = lambda x: b'{"conversations": [{"role": "user", "content": "' + x + b'"}]}'
    write(e, "x.jsonl", [msg("real �".encode()), msg("cut � ".encode() + b"\xff\xfe."), msg(b"plain")])
    got = [r.text for r in scan_tokenizer_corpus(spark, e).orderBy("line_no").collect()]
    assert got == ["real �", "cut � .", "plain"]
