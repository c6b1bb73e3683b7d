from pyspark.sql import functions as F

from tessera.operators import audio, chat, sequences


def test_scheduled_sampling_only_touches_supervised(spark):
    ids = list(range(100, 300))
    labels = [-100] * 100 + ids[100:]
    df = spark.createDataFrame([(k, ids, labels) for k in range(20)], "k long, ids array<int>, labels array<int>")
    out = df.select(sequences.scheduled_sampling("ids", "labels", "k", p=0.3).alias("x")).collect()
    changed_head = sum(a != b for r in out for a, b in zip(r.x[:100], ids[:100]))
    changed_tail = sum(a != b for r in out for a, b in zip(r.x[100:], ids[100:]))
    assert changed_head == 0 and 0 < changed_tail < 20 * 100


def test_voice_prefix_and_media(spark):
    df = spark.createDataFrame([(10, 4, True), (3, 8, True), (3, 8, False)], "s int, n int, spk boolean")
    r = df.select(sequences.voice_prefix(F.col("s"), F.col("n"), F.col("spk")).alias("v")).collect()
    assert (r[0].v.ref_start, r[0].v.keep_from, r[0].v.spk_pos) == (6, 0, 5)
    assert (r[1].v.ref_start, r[1].v.keep_from, r[1].v.spk_pos) == (1, 6, 0)
    assert (r[2].v.ref_start, r[2].v.keep_from, r[2].v.spk_pos) == (0, 5, -1)
    conv = F.array(chat.make_message(F.lit("user"), F.lit("a")), chat.make_message(F.lit("assistant"), F.lit("b")),
                   chat.make_message(F.lit("user"), F.lit("c")))
    m = spark.range(1).select(audio.select_media(conv, F.array(F.lit(b"q1"), F.lit(b"q2")),
                                                 F.array(F.array(F.lit(1)), F.array(F.lit(2))),
                                                 F.array(F.lit(b"img"))).alias("m")).first().m
    assert m.question_audio == bytearray(b"q2") and m.answer_codes == [1] and m.image == bytearray(b"img")


def test_observation_mask(spark):
    t = spark.createDataFrame([(1, 0, [5, 6], [-0.1, -0.2], [9, 9, 9]), (1, 1, [7], [-0.3], None),
                               (1, 3, [8], [-0.4], None)],
                              "k long, turn int, model_ids array<int>, model_logps array<double>, obs_ids array<int>")
    r = sequences.observation_mask(t, "k").first()
    assert r.ids == [5, 6, 9, 9, 9, 7] and r.mask == [1, 1, 0, 0, 0, 1] and r.logps == [-0.1, -0.2, 0.0, 0.0, 0.0, -0.3]


def test_voice_names_and_eval_prompts(spark):
    names = spark.createDataFrame([(" my   voice ",), ("",), ("DEFAULT",), ("x" * 25,), ("alice",)], "name string")
    reg = spark.createDataFrame([("alice", "builtin"), ("bob", "manual")], "name string, grp string")
    got = {r.voice: r.reject for r in chat.validate_voice_names(names, reg).collect()}
    assert got == {"my voice": None, "voice_clone": None, "DEFAULT": "reserved", "x" * 25: "too_long", "alice": "taken"}
    p = spark.range(1).select(chat.build_eval_prompts(F.lit("hi")).alias("p"),
                              chat.build_eval_prompts(F.lit("hi"), weight_name="pretrain_768").alias("q")).first()
    assert p.p == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert p.q == "<|im_start|>hi"


def test_layered_loss_weights_stop(spark):
    t = spark.createDataFrame([(0, 0, 5, 1.0), (0, 0, 2050, 1.0), (0, 1, -100, 9.0)],
                              "s int, layer int, target int, loss double")
    r = audio.layered_loss(t, ["s"]).first()
    assert abs(r.audio_loss - (1.0 + 10.0) / 2 / 8) < 1e-6


def test_speech_rows_by_hand(spark):
    """An overlay written position by position, for every mix of reference, marker, room and length."""
    def by_hand(answer, start, max_len, ref, spk):
        x = [[2049] * max_len for _ in range(8)]
        y = [[-100] * max_len for _ in range(8)]
        if answer:
            at = start
            if len(ref) >= 8:
                n = len(ref) // 8
                at = max(int(spk), start - n)
                for j in range(8):
                    for i, c in enumerate([ref[8 * f + j] for f in range(n)][max(0, n - (start - at)):]):
                        x[j][at + i] = c
            if spk and at > 0:
                for j in range(8):
                    x[j][at - 1] = 2051
            for j in range(8):
                for i, c in enumerate(answer[j]):
                    if start + j + 1 + i < max_len:
                        x[j][start + j + 1 + i] = y[j][start + j + 1 + i] = c
        return x, y

    rows = []
    for k, (start, frames, spk, n) in enumerate((s, f, m, n) for s in (2, 6, 12) for f in (0, 1, 5, 9) for m in (False, True) for n in (0, 1, 6)):
        answer = [[100 * j + i for i in range(n)] + [2050] for j in range(8)] if n else None
        rows.append((k, answer, start, list(range(500, 500 + 8 * frames + k % 8)), spk))
    df = spark.createDataFrame(rows, "k int, answer array<array<int>>, start int, ref array<int>, spk boolean")
    got = {r.k: r.r for r in df.select("k", audio.speech_rows("answer", F.col("start"), 20, "ref", F.col("spk")).alias("r")).collect()}
    for k, answer, start, ref, spk in rows:
        assert (got[k].input, got[k].labels) == by_hand(answer, start, 20, ref, spk), (k, start, len(ref), spk)


def test_rollout_observations(spark):
    """The rollout loop turn by turn; a re-rendered context that is shorter adds nothing, pads and ends leave the new ids."""
    turns = [(1, 0, [1, 2, 9], [7, 0, 8, 2], [-0.1, -0.2, -0.3, -0.4], 1, [1, 2, 9, 7, 8, 50, 51]),
             (1, 1, [1, 2, 9, 7, 8, 50, 51], [6], [-0.5], 1, [1, 2]), (1, 2, [], [5], [-0.6], 2, list(range(12))),
             (2, 0, [3], [4, 4], [-1.0, -2.0], 0, None), (2, 1, [3], [5], [-1.0], 1, [9, 9, 9, 9, 9]),
             (3, 0, [3], [], [], 1, None)]
    df = spark.createDataFrame(turns, "k long, turn int, context_ids array<int>, new_ids array<int>, new_logps array<double>, calls int, observe_ids array<int>")
    got = {r.k: r for r in sequences.assemble_rollout(df, "k").collect()}
    assert got[1].ids == [7, 8, 50, 51, 6, 5, 9, 10, 11] and got[1].mask == [1, 1, 0, 0, 1, 1, 0, 0, 0] and got[1].unfinished
    assert got[1].logps == [-0.1, -0.3, 0.0, 0.0, -0.5, -0.6, 0.0, 0.0, 0.0] and got[1].prompt_ids == [1, 2, 9]
    assert got[2].ids == [4, 4] and got[2].mask == [1, 1] and not got[2].unfinished
    assert got[3].ids == [] and not got[3].unfinished


def test_response_lengths(spark):
    rows = [([5, 2, 6, 2], [1, 1, 1, 1], 2), ([5, 6, 0, 0], [1, 1, 0, 0], 2), ([0, 2], [0, 0], 1), ([], [], 1), ([2, 5], [0, 1], 1)]
    df = spark.createDataFrame(rows, "ids array<int>, mask array<int>, n int")
    assert all(r.got == r.n for r in df.select("n", sequences.response_lengths("ids", "mask").alias("got")).collect())


def test_media_prompts_and_lengths(spark):
    rows = [("t", 3, 2), ("t", 0, None), ("t", None, 1), ("", None, 1), (None, None, None), ("", 1, 1)]
    got = spark.createDataFrame(rows, "t string, f int, i int").select(chat.media_prompt("t", "f", "i").alias("p")).collect()
    a, i = "<|audio_pad|>", "<|image_pad|>"
    assert [r.p for r in got] == ["t" + a * 3 + "\n\n" + i * 2, "t" + a, "t\n\n" + i, i, "", a + "\n\n" + i]
    conv = F.array(*[F.struct(F.lit(r).alias("role")) for r in ("user", "assistant", "user")])
    pick = lambda audios, valid: spark.range(1).select(audio.select_media(
        conv, F.array(*map(F.lit, audios)), F.array(F.array(F.lit(1))), F.array(F.lit("x")), F.array(*map(F.lit, valid))).alias("m")).first().m
    assert [(m.question_audio, m.audio_length, m.audio_tokens) for m in (
        pick(["a", "b"], [4, 9]), pick(["a", "b"], [4, 0]), pick(["a"], [4]), pick(["a", ""], [4, 9]))] == [("b", 9, 9), ("b", 0, 1), (None, 0, 0), (None, 0, 0)]
