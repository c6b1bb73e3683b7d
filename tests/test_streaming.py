import random

from tessera.streaming import keyed
from tessera.streaming.segments import Segmenter, speech_segments, speech_segments_stream, windows_for
from tessera.streaming.text import delta_parts, incremental_pieces, split_deltas
from tessera.operators.tokenizer import encode_bytes_py


def run(probs, gen=None, **kw):
    session = Segmenter(windows_for(kw.get("ms", 2048)), windows_for(kw.get("sil", 12800)))
    for i, p in enumerate(probs):
        session.push(i, p > kw.get("thr", 0.5), bool(gen and gen[i]))
    return session.events


def test_noise_shorter_than_minimum_is_dropped():
    assert run([0.1, 0.9, 0.9, 0.1] + [0.1] * 30) == []


def test_segment_with_preroll_and_trimmed_tail():
    probs = [0.1, 0.2] + [0.9] * 4 + [0.1] * 25 + [0.1] * 3
    out = run(probs)
    # pre-roll window 1, speech 2..5, 25 silent windows 6..30 -> all but one trimmed -> end at 6
    assert out == [("speech_end", 0, 1, 6)]


def test_two_segments_and_interrupt():
    probs = ([0.9] * 4 + [0.1] * 25) * 2
    gen = [False] * 29 + [True] * 29
    out = run(probs, gen)
    assert [o[0] for o in out] == ["speech_end", "interrupt", "speech_end"]
    # no pre-roll for the second segment: the ring is emptied when speech starts and only an idle
    # low window refills it
    assert out[0][2:] == (0, 4) and out[2][2:] == (29, 33)


def test_stream_equals_batch(spark):
    from tessera.plans import fixtures as fx
    from tessera.plans import streams
    from conftest import SF_SMALL
    chunks = fx.audio_chunks(spark, SF_SMALL)
    kw = dict(thr=0.5, min_speech=1024, min_silence=1024)
    batch = sorted(tuple(r) for r in speech_segments(chunks, **kw).collect())
    src = streams.stream_from(spark, chunks, "t-chunks", files=3)
    stream = sorted(tuple(r) for r in streams.run_available_now(
        spark, speech_segments_stream(src, **kw), "t-seg").collect())
    assert batch == stream and len(batch) > 0


def test_incremental_decode_splits_multibyte():
    ids = encode_bytes_py("a中b").tolist()
    assert incremental_pieces(ids) == [(0, 0, "a"), (1, 3, "中"), (4, 4, "b")]
    assert incremental_pieces(ids[:3]) == [(0, 0, "a")]         # trailing incomplete bytes are held


def test_batch_equals_stepping_on_random_sessions(spark):
    rng = random.Random(11)
    rows, want = [], []
    for key in range(60):
        p_loud = rng.choice([0.3, 0.6, 0.85])
        probs, gen = [], []
        while len(probs) < rng.randint(5, 60):
            probs += [0.9 if rng.random() < p_loud else 0.1] * rng.randint(1, 4)
        gen = [rng.random() < 0.3 for _ in probs]
        rows += [(key, i, p, g) for i, (p, g) in enumerate(zip(probs, gen))]
        want += [(key, e, n, a, b, b - a + 1) for e, n, a, b in run(probs, gen, ms=1024, sil=1536)]
    df = spark.createDataFrame(rows, "session_id long, seq long, prob double, generating boolean")
    got = [tuple(r) for r in speech_segments(df, min_speech=1024, min_silence=1536, generating="generating").collect()]
    assert sorted(got) == sorted(want) and want


def test_split_deltas(spark):
    out = delta_parts(["abc</thi", "nk>\n\nhel", "lo"])
    assert out == [(0, "reasoning", "abc</thi"), (1, "content", "hel"), (2, "content", "lo"), (2, "finish", "stop")]
    assert delta_parts(["x"], open_thinking=False) == [(0, "content", "x"), (0, "finish", "stop")]
    call = '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>'
    assert delta_parts([call + "</think>", "done"]) == [(0, "reasoning", call), (1, "content", "done"), (1, "finish", "stop")]
    assert delta_parts(["r</think>", call])[-2:] == [(1, "tool_call", '{"name": "f", "arguments": {"a": 1}}'), (1, "finish", "tool_calls")]
    df = spark.createDataFrame([(7, 1, "nk>b"), (7, 0, "a</thi"), (8, 0, "only")], "request_id long, seq long, delta string")
    rows = sorted(tuple(r) for r in split_deltas(df).collect())
    assert rows == [(7, 0, "reasoning", "a</thi"), (7, 1, "content", "b"), (7, 1, "finish", "stop"), (8, 0, "finish", "stop"), (8, 0, "reasoning", "only")]


def test_gap_policy_waits_then_skips():
    session = Segmenter(4, 25)
    pending = {0: (True, False), 1: (True, False), 3: (True, False)}
    session.drain(pending)
    assert session.next_seq == 2 and list(pending) == [3]
    session.drain(pending, skip_gap=True)
    assert session.next_seq == 4 and pending == {} and session.loud_run == 3 and not session.events


def test_lost_windows_restarts_and_ended_sessions(spark, tmp_path):
    """A feed that loses windows, in three parts with a restart between: stream = batch, and sessions that ended leave no state."""
    from pyspark.sql import functions as F
    from tessera.plans import streams
    rng, rows = random.Random(4), []
    for key in range(12):
        rows += [(key, i, 0.9 if rng.random() < 0.6 else 0.1, rng.random() < 0.3, key * 4000 + 32 * i) for i in range(rng.randint(20, 120)) if rng.random() > 0.06]
    rows.append((99, 0, 0.1, False, 10_000_000))
    df = spark.createDataFrame(rows, "session_id long, seq long, prob double, generating boolean, ms long").withColumn("at", F.timestamp_millis("ms"))
    kw = dict(min_speech=1024, min_silence=1536, generating="generating")
    batch = sorted(tuple(r) for r in speech_segments(df, **kw).collect())
    src, root, sizes = str(tmp_path / "in"), str(tmp_path / "job"), []
    for low, high in ((0, 20_000), (20_000, 30_000), (30_000, 1 << 40)):
        df.where(f"ms >= {low} and ms < {high}").drop("ms").orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.drop("ms").schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = streams.run_available_now(spark, speech_segments_stream(stream, at="at", patience_ms=1000, idle_ms=8000, **kw), "t", root=root)
        sizes.append(spark.read.format("statestore").load(f"{root}/checkpoint").count())
        got = sorted(tuple(r) for r in out.collect())
        assert set(got) <= set(batch)
    assert got == batch and len(batch) > 20
    assert sizes[-1] == 1 and sizes[0] > 1


def by_fold(fold, rows):
    return keyed.fold_rows(fold(), rows)


def test_folds_do_not_depend_on_the_cut(spark, tmp_path):
    """Rows in any order over micro-batches and a restart give what the whole key in order gives; ended keys leave no state."""
    from pyspark.sql import functions as F
    from tessera.plans import streams
    rng = random.Random(8)
    whole = {k: ["".join(rng.choice(["</th", "ink>", "a", "\n", "x y", "</think>", "<think>"]) for _ in range(2)) for _ in range(rng.randint(1, 9))] for k in range(15)}
    rows = [(k, i, d, i == len(ds) - 1) for k, ds in whole.items() for i, d in enumerate(ds)]
    rng.shuffle(rows)
    folds = {"split": (keyed.SplitDelta, ["delta"]), "chunks": (keyed.overlapping(3, 2), ["delta"]), "history": (keyed.history(2), ["delta", "delta2"])}
    for name, (fold, cells) in folds.items():
        src, root = str(tmp_path / name / "in"), str(tmp_path / name / "job")
        for part in (rows[:20], rows[20:45], rows[45:]):
            df = spark.createDataFrame(part, "k long, n long, delta string, last boolean").withColumn("delta2", F.upper("delta"))
            df.coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(df.schema).parquet(src)
            out = streams.run_available_now(spark, keyed.stream_of(stream, fold, "k", "n", cells, "last"), name, root=root)
        want = [(k, *map(repr, r)) for k, ds in whole.items() for r in by_fold(fold, [(i, d, d.upper())[:1 + len(cells)] for i, d in enumerate(ds)])]
        got = [(r[0], *map(repr, r[1:])) for r in out.collect()]
        if name == "history":  # rows come back as Row
            got = [(r[0], repr(r[1]), repr(r[2]), repr(r[3]), repr([tuple(m) for m in r[4]])) for r in out.collect()]
        assert sorted(got) == sorted(want), name
        assert spark.read.format("statestore").load(f"{root}/checkpoint").count() == 0


def test_split_fold_equals_the_batch_form():
    rng = random.Random(9)
    for _ in range(300):
        deltas = ["".join(rng.choice(["</th", "ink>", "a", "\n", "</think>", '<tool_call>{"name": "f"}</tool_call>']) for _ in range(rng.randint(1, 3)))
                  for _ in range(rng.randint(1, 6))]
        assert by_fold(keyed.SplitDelta, list(enumerate(deltas))) == delta_parts(deltas), deltas


def test_decode_fold_equals_the_batch_form():
    for text in ("a中b😀", "", "é" * 5, "plain"):
        ids = encode_bytes_py(text).tolist()
        got = [(a, b, t) for _, a, b, t in by_fold(keyed.Decode, list(enumerate(ids)))]
        assert got == incremental_pieces(ids) and "".join(t for _, _, t in got) == text


def test_training_rows_from_json_lines(spark, tmp_path):
    """Stream over files that keep coming, with a restart: rows equal the batch job's, malformed lines are told apart."""
    import json
    from pyspark.sql import functions as F
    from tessera.plans import streams
    from tessera.plans.sft import sft_samples
    from tessera.sources import schemas
    lines, root = tmp_path / "lines", str(tmp_path / "job")
    lines.mkdir()
    talk = lambda i: [{"role": "user", "content": f"q {i}"}, {"role": "assistant", "content": f"a {i}"}]
    good = [json.dumps({"id": str(i), "conversations": talk(i)}) for i in range(9)] + [json.dumps({"conversations": talk(77)})]
    bad = ["{broken", "", '{"id": "5", "conversations": []}', '{"conversations": [null]}', '"text"', '{"id": 3}']
    for n, part in enumerate((good[:4] + bad[:2], good[4:] + bad[2:])):
        (lines / f"{n}.jsonl").write_text("\n".join(part) + "\n")
        samples, rejects = streams.sft_samples_stream(spark, str(lines), root)
    parsed = spark.createDataFrame([(x,) for x in good], "value string").withColumn("j", F.from_json("value", "id string, conversations " + schemas.CONVERSATION.simpleString()))
    conv = parsed.select(F.coalesce("j.id", F.md5("value")).alias("sample_id"), "j.conversations")
    want = sft_samples(conv, key="sample_id", with_tools=False).select("sample_id", "input_ids", "labels").collect()
    assert sorted(tuple(r) for r in samples.collect()) == sorted(tuple(r) for r in want) and len(want) == 10
    assert sorted(r.reason for r in rejects.collect()) == ["empty"] + ["malformed"] * 4 + ["null message"]
    assert streams.sft_samples_stream(spark, str(lines), root)[0].count() == 10  # nothing new, nothing twice


def test_restart_goes_on_and_retries_write_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.plans import streams
    root, src = str(tmp_path / "job"), str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    double = lambda df: df.select((F.col("id") * 2).alias("x"))
    assert streams.run_available_now(spark, stream(), "t", double, root).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    rows = [r.x for r in streams.run_available_now(spark, stream(), "t", double, root).collect()]
    assert sorted(rows) == [2 * i for i in range(15)]
