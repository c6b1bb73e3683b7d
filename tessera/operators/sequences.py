"""Sequence building (Q1-Q26) as array expressions: fixed per-row logic stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.functions.tokens import BOS_ID, EOS_ID, IGNORE_INDEX, PAD_ID


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ints(vals) -> Column:
    return F.array(*[F.lit(int(v)) for v in vals])


def tail(arr, n) -> Column:
    """Python ``a[-n:]`` (all elements when n > size; Spark's slice(a,-n,n) would return [])."""
    arr = _c(arr)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))


def head(arr, n) -> Column:
    arr = _c(arr)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)))


def wrap_truncate(ids, max_len: int, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """Q1: BOS + first max_len-2 ids + EOS."""
    return F.concat(F.array(F.lit(bos)), head(ids, max_len - 2), F.array(F.lit(eos)))


def pad_right(ids, max_len: int, pad: int = PAD_ID) -> Column:
    """Q2: truncate to max_len, then right-pad."""
    t = head(ids, max_len)
    return F.concat(t, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(t)))


def mask_pad_labels(ids, pad: int = PAD_ID) -> Column:
    """Q3: label = id, with every pad id (wherever it occurs) -> -100."""
    return F.transform(_c(ids), lambda x: F.when(x == pad, F.lit(IGNORE_INDEX)).otherwise(x))


def assistant_spans(ids, bos_seq: list[int], eos_seq: list[int]) -> Column:
    """Q4: ``array<struct<start:int, end:int>>`` (1-based) of supervised spans.

    Scan for ``bos_seq``; a span starts right after it and ends at the next ``eos_seq`` (``end`` = its
    first position) or at size+1 when none follows; scanning resumes after the end marker.  Candidate
    markers inside a previous span are skipped by a left fold over the candidates.  The end-marker
    positions ride in the fold's accumulator so they are computed once per row (an outer expression
    referenced inside a lambda would be re-evaluated per element).
    """
    ids = _c(ids)
    n = F.size(ids)
    kb, ke = len(bos_seq), len(eos_seq)
    bos_arr, eos_arr = _ints(bos_seq), _ints(eos_seq)
    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cands = F.filter(positions, lambda i: (F.element_at(ids, i) == bos_seq[0]) & (F.slice(ids, i, kb) == bos_arr))
    ends = F.filter(positions, lambda j: (F.element_at(ids, j) == eos_seq[0]) & (F.slice(ids, j, ke) == eos_arr))
    span_t = "array<struct<start:int,end:int>>"
    init = F.struct(F.lit(1).alias("next"), F.array().cast(span_t).alias("spans"), ends.alias("ends"),
                    (n + 1).alias("stop"))

    def step(acc, c):
        s = c + kb
        e = F.coalesce(F.array_min(F.filter(acc["ends"], lambda j: j >= s)), acc["stop"])
        nxt = F.when(e < acc["stop"], e + ke).otherwise(acc["stop"])
        span = F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
        taken = F.struct(nxt.alias("next"), F.concat(acc["spans"], F.array(span)).alias("spans"),
                         acc["ends"].alias("ends"), acc["stop"].alias("stop"))
        return F.when(c >= acc["next"], taken).otherwise(acc)

    return F.aggregate(cands, init, step, lambda acc: acc["spans"])


def span_mask(n, spans, eos_len: int, max_len: int | None = None, keep_last_only: bool = False) -> Column:
    """0/1 array of length n: 1 inside a span (end marker included) and within max_len."""
    n = n if isinstance(n, Column) else F.lit(n)
    spans = _c(spans)
    if keep_last_only:
        spans = tail(spans, 1)
    bound = F.lit(max_len) if max_len is not None else n

    def paint(acc, sp):
        hi = F.least(sp["end"] + eos_len - 1, bound)
        return F.transform(acc, lambda v, i: F.when((i + 1 >= sp["start"]) & (i + 1 <= hi), F.lit(1)).otherwise(v))

    return F.aggregate(spans, F.array_repeat(F.lit(0), n), paint)


def span_labels(ids, spans, eos_len: int, max_len: int | None = None, keep_last_only: bool = False) -> Column:
    """Q5 (Q7 with ``keep_last_only``): -100 except inside spans, end marker included, bounded by max_len."""
    ids = _c(ids)
    mask = span_mask(F.size(ids), spans, eos_len, max_len, keep_last_only)
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE_INDEX)))


def loss_mask(ids, spans, eos_len: int, max_len: int | None = None) -> Column:
    """Q6: the same spans as 0/1."""
    return span_mask(F.size(_c(ids)), spans, eos_len, max_len)


def shift_xy(ids) -> tuple[Column, Column]:
    """Q8: x = all but last, y = all but first."""
    ids = _c(ids)
    n = F.size(ids)
    return F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0)))


def pad_to_batch(df, batch: str, fill: dict[str, Column]):
    """Q12: arrays named by ``fill`` padded on the right, with its values, to the longest of ``batch`` (of the first array
    named; the others must be as long).  One partial aggregation and an equi-join on the batch."""
    first = next(iter(fill))
    longest = df.groupBy(batch).agg(F.max(F.size(first)).alias("_longest"))
    short = F.col("_longest") - F.size(first)
    return df.join(longest, batch).withColumns({c: F.concat(F.col(c), F.array_repeat(v, short)) for c, v in fill.items()}).drop("_longest")


def left_truncate_pad(ids, max_len: int, pad: int = PAD_ID) -> tuple[Column, Column]:
    """Q10: keep the last max_len ids, left-pad to max_len; returns (ids, attention_mask)."""
    t = tail(ids, max_len)
    npad = F.lit(max_len) - F.size(t)
    return (F.concat(F.array_repeat(F.lit(pad), npad), t),
            F.concat(F.array_repeat(F.lit(0), npad), F.array_repeat(F.lit(1), F.size(t))))


def first_supervised_pos(mask) -> Column:
    """Q13: 0-based index of the first 1 in the mask, else its length."""
    mask = _c(mask)
    p = F.array_position(mask, 1)
    return F.when(p > 0, p - 1).otherwise(F.size(mask)).cast("int")


def first_eos_mask(ids, pad_mask, eos: int = EOS_ID) -> Column:
    """Q16: 1 up to and including the first EOS that is not padding, AND the pad mask; no EOS -> pad mask."""
    ids, pad_mask = _c(ids), _c(pad_mask)
    eos_pos = F.array_position(F.zip_with(ids, pad_mask, lambda x, m: (x == eos) & (m == 1)), True)
    # the position enters the second pass as a lambda variable, so it is looked up once a row and not once an element
    first = lambda st: F.transform(st["m"], lambda m, i: F.when(((st["e"] == 0) | (i + 1 <= st["e"])) & (m == 1), F.lit(1)).otherwise(F.lit(0)))
    return let(F.struct(eos_pos.alias("e"), pad_mask.alias("m")), first)


def response_lengths(ids, pad_mask, eos: int = EOS_ID) -> Column:
    """Q16: tokens up to and including the first EOS that is not padding, without one all that are not padding; 1 at least."""
    ids, pad_mask = _c(ids), _c(pad_mask)
    eos_pos = F.array_position(F.zip_with(ids, pad_mask, lambda x, m: (x == eos) & (m == 1)), True)
    real = F.aggregate(pad_mask, F.lit(0).cast("long"), lambda n, m: n + m)
    return F.greatest(F.when(eos_pos > 0, eos_pos).otherwise(real), F.lit(1).cast("long"))


def align_logprobs(lp, n) -> Column:
    """Q15: shorter -> front-pad 0.0; longer -> keep the tail."""
    lp = _c(lp)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.size(lp) < n, F.concat(F.array_repeat(F.lit(0.0), n - F.size(lp)), lp)).otherwise(tail(lp, n))


def placeholder_runs(tokens, key: str, pos: str = "pos", tid: str = "token_id", marker: int = 12):
    """Q17 (gaps and islands): maximal runs of ``marker`` per key as ``(key, k, start, length)``;
    the k-th run pairs with the k-th media item (J7)."""
    from pyspark.sql import Window
    m = tokens.filter(F.col(tid) == marker)
    w = Window.partitionBy(key).orderBy(pos)
    isl = m.withColumn("_isl", F.col(pos) - F.row_number().over(w))
    runs = isl.groupBy(key, "_isl").agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("length"))
    wk = Window.partitionBy(key).orderBy("start")
    return runs.withColumn("k", F.row_number().over(wk) - 1).drop("_isl")


def skip_think_prefix(ids, start, marker: list[int], window: int = 50, end=None) -> Column:
    """Q22: if ``marker`` (``</think>\\n\\n``) starts within ``window`` positions from ``start`` (1-based) and before
    ``end`` (the span's first position outside, default: after the ids), return the position after it, else ``start``."""
    ids = _c(ids)
    s = start if isinstance(start, Column) else F.lit(start)
    stop = F.size(ids) + 1 if end is None else end if isinstance(end, Column) else F.lit(end)
    arr = _ints(marker)
    last = F.least(s + window, stop, F.size(ids) + 1) - 1
    cand = F.when(last >= s, F.filter(F.sequence(s, last), lambda i: F.slice(ids, i, len(marker)) == arr))
    return F.coalesce(F.try_element_at(cand, F.lit(1)) + len(marker), s)


def pack_prompt_response(p, r, m, lp, max_total: int = 2500) -> tuple[Column, Column, Column]:
    """Q11: ids = p + r; mask = 0s + m; logp = 0s (len p - 1) + lp; keep the tail when too long."""
    p, r, m, lp = _c(p), _c(r), _c(m), _c(lp)
    ids = F.concat(p, r)
    mask = F.concat(F.array_repeat(F.lit(0), F.size(p)), m)
    logp = F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.size(p) - 1, F.lit(0))), lp)
    return tail(ids, max_total), tail(mask, max_total), tail(logp, max_total - 1)


def drop_special_pairs(ids, logps, drop=(PAD_ID, EOS_ID)) -> tuple[Column, Column]:
    """Q14: zip ids with logps, drop pad/eos, unzip."""
    z = F.filter(F.arrays_zip(_c(ids).alias("i"), _c(logps).alias("l")), lambda x: ~x["i"].isin(*drop))
    return F.transform(z, lambda x: x["i"]), F.transform(z, lambda x: x["l"])


def scheduled_sampling(ids, labels, key, p: float = 0.05, vocab: int = 6400, image_pad: int = 12,
                       seed: int = 42) -> Column:
    """Q23 (text row): where a position is supervised and not the image pad, with probability p replace the
    input id by a uniform id in [0, vocab).  Draws are keyed by (row, position)."""
    from tessera.functions.rand import keyed_uniform
    ids, labels = _c(ids), _c(labels)
    k = F.col(key) if isinstance(key, str) else key

    def draw(i, tag):
        return keyed_uniform(F.concat_ws(":", k.cast("string"), i.cast("string")), tag, seed)

    return F.transform(ids, lambda x, i: F.when(
        (F.element_at(labels, i + 1) != IGNORE_INDEX) & (x != image_pad) & (draw(i, "ss") < p),
        F.floor(draw(i, "ssv") * vocab).cast("int")).otherwise(x))


def scheduled_sampling_audio(layers, audio_labels, key, p: float = 0.05, audio_vocab: int = 2112,
                             seed: int = 42) -> Column:
    """Q23 (audio rows): at positions where any layer has a label, with probability p replace all 8 input
    codes by uniform codes in [0, audio_vocab).  ``layers`` / ``audio_labels``: array<array<int>> (8 x T)."""
    from tessera.functions.rand import keyed_uniform
    L, A = _c(layers), _c(audio_labels)
    k = F.col(key) if isinstance(key, str) else key
    u = lambda i, tag: keyed_uniform(F.concat_ws(":", k.cast("string"), i.cast("string")), tag, seed)
    any_label = lambda i: F.exists(A, lambda row: F.element_at(row, i + 1) != IGNORE_INDEX)
    code = lambda i, j: F.floor(keyed_uniform(
        F.concat_ws(":", k.cast("string"), i.cast("string"), j.cast("string")), "ssav", seed) * audio_vocab).cast("int")
    return F.transform(L, lambda row, j: F.transform(row, lambda x, i: F.when(
        any_label(i) & (u(i, "ssa") < p), code(i, j)).otherwise(x)))


def voice_prefix(start, ref_len, has_spk, slots: int | None = None) -> Column:
    """Q21: placement of reference codes that end where the assistant audio starts (``start``), keeping the
    tail when too long and reserving one slot for the speaker marker 2051 just before them.
    Returns struct(ref_start, keep_from, spk_pos) -- keep_from is the first kept reference frame, spk_pos
    is -1 without a speaker embedding."""
    s = start if isinstance(start, Column) else F.lit(start)
    n = ref_len if isinstance(ref_len, Column) else F.lit(ref_len)
    spk = has_spk if isinstance(has_spk, Column) else F.lit(bool(has_spk))
    reserve = F.when(spk, F.lit(1)).otherwise(F.lit(0))
    ref_start = F.greatest(reserve, s - n)
    room = s - ref_start
    keep_from = F.when(n > room, n - room).otherwise(F.lit(0))
    spk_pos = F.when(spk & (ref_start > 0), ref_start - 1).otherwise(F.lit(-1))
    return F.struct(ref_start.alias("ref_start"), keep_from.alias("keep_from"), spk_pos.alias("spk_pos"))


def observation_mask(turns, key: str, turn: str = "turn", model_ids: str = "model_ids",
                     obs_ids: str = "obs_ids", max_turns: int = 3):
    """Q26: multi-turn response assembly per rollout: model tokens get mask 1 (their logps kept),
    tool-observation tokens between turns get mask 0 and logp 0.0; at most ``max_turns`` turns.
    ``turns``: (key, turn, model_ids, model_logps, obs_ids).  Returns (key, ids, mask, logps)."""
    t = turns.filter(F.col(turn) < max_turns)
    part = F.struct(
        F.col(turn).alias("t"),
        F.concat(F.col(model_ids), F.coalesce(F.col(obs_ids), F.array().cast("array<int>"))).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(model_ids)),
                 F.array_repeat(F.lit(0), F.coalesce(F.size(obs_ids), F.lit(0)))).alias("mask"),
        F.concat(F.col("model_logps"),
                 F.array_repeat(F.lit(0.0), F.coalesce(F.size(obs_ids), F.lit(0)))).alias("lp"))
    g = t.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return g.select(key, F.flatten("_p.ids").alias("ids"), F.flatten("_p.mask").alias("mask"),
                    F.flatten("_p.lp").alias("logps"))


def assemble_rollout(turns, key: str, turn: str = "turn", max_turns: int = 3):
    """Q26: the response of a multi-turn rollout, (key, prompt_ids, ids, mask, logps, unfinished).

    ``turns``: (key, turn from 0, context_ids, new_ids, new_logps, calls, observe_ids).  Pad and end tokens leave the new ids (Q14; mask 1).
    A turn without calls ends the rollout.  After one with calls the context is rendered anew with the tools' results, and
    what lies beyond the known length is the observation (mask 0, logp 0.0): a shorter context adds nothing.  With n new ids
    a turn and o ids of its new context, the known length is S + max(prompt, o - S so far), S the running sum of n: two
    windows, no fold.  ``unfinished``: the last allowed turn still has calls.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(turn)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ids, lps = drop_special_pairs("new_ids", "new_logps")
    t = turns.where(F.col(turn) < max_turns).withColumns({"_ids": ids, "_lps": lps})
    t = t.withColumn("_over", F.coalesce(F.max((F.col("calls") == 0).cast("int")).over(before), F.lit(0))).where("_over = 0")
    t = t.withColumns({"_sum": F.sum(F.size("_ids")).over(so_far), "_prompt": F.first(F.size("context_ids")).over(so_far)})
    t = t.withColumn("_gap", F.when(F.col("calls") > 0, F.size("observe_ids") - F.col("_sum")))
    known = F.col("_sum") + F.greatest("_prompt", F.coalesce(F.max("_gap").over(before), F.col("_prompt")))
    t = t.withColumn("_known", known)
    seen = F.slice("observe_ids", F.least(F.col("_known"), F.size("observe_ids")).cast("int") + 1, F.size("observe_ids"))
    delta = F.when(F.col("calls") > 0, F.coalesce(seen, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("_delta", delta)
    part = F.struct(F.col(turn).alias("t"), F.concat("_ids", "_delta").alias("ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), F.size("_delta"))).alias("mask"),
                    F.concat("_lps", F.array_repeat(F.lit(0.0), F.size("_delta"))).alias("lp"))
    g = t.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p"), F.min(F.struct(turn, "context_ids")).alias("_c"),
                           F.max((F.col(turn) == max_turns - 1) & (F.col("calls") > 0)).alias("unfinished"))
    return g.select(key, F.col("_c.context_ids").alias("prompt_ids"), F.flatten("_p.ids").alias("ids"), F.flatten("_p.mask").alias("mask"),
                    F.flatten("_p.lp").alias("logps"), "unfinished")
