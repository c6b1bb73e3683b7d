"""Audio-code sequences (Q18-Q20, Q24), clip quality (A15), feature centering helpers and
array augmentation (G1, G2).  Codes are 0..2047; pad 2049, stop 2050, speaker 2051."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rand import keyed_uniform
from tessera.sources.tables import number_within, with_group_count

AUDIO_PAD, AUDIO_STOP, AUDIO_SPK = 2049, 2050, 2051
N_LAYERS = 8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def audio_code_layers(tokens, stop: int = AUDIO_STOP) -> Column:
    """Q18: frame-major flat codes -> 8 layers (trailing partial frame dropped), stop code appended."""
    t = _c(tokens)
    usable = F.floor(F.size(t) / N_LAYERS) * N_LAYERS
    return F.transform(F.sequence(F.lit(0), F.lit(N_LAYERS - 1)), lambda j: F.concat(
        F.filter(t, lambda x, i: (i % N_LAYERS == j) & (i < usable)), F.array(F.lit(stop))))


def delay_pattern_long(layers: DataFrame, key: str, start, max_len: int) -> DataFrame:
    """Q19 in long form: ``(key, layer, pos, code)`` with layer l's i-th code at ``start + l + 1 + i``,
    clipped at max_len.  Positions not listed are background (input 2049, label -100)."""
    s = _c(start) if not isinstance(start, int) else F.lit(start)
    ex = layers.select(key, s.alias("_start"), F.posexplode("layers").alias("layer", "codes"))
    ex = ex.select(key, "layer", "_start", F.posexplode("codes").alias("i", "code"))
    ex = ex.withColumn("pos", F.col("_start") + F.col("layer") + 1 + F.col("i"))
    return ex.filter(F.col("pos") < max_len).select(key, "layer", "pos", "code")


def speech_rows(answer, start, max_len: int, ref=None, has_spk=False, use_ref=None) -> Column:
    """Q19 + Q21 as arrays: struct(input, labels) of 8 rows of ``max_len`` codes each.

    Later of these wins on the position grid: background (input 2049, label -100); reference codes that end where the answer starts,
    their tail where there is no room for all; the speaker marker 2051 just before them; layer l's answer codes
    from ``start + l + 1`` on, which alone are labels.  A row is its stretches one after the other, cut at ``max_len``.

    ``answer`` holds 8 arrays (null or empty: background only, no reference and no marker); ``ref`` is flat, frame-major; ``use_ref`` says
    whether it is used (the draw of ``reference_draw``).
    """
    first = start if isinstance(start, Column) else F.lit(start)
    spoken = F.coalesce(F.size(_c(answer)) == N_LAYERS, F.lit(False))
    flat = F.coalesce(_c(ref), F.array().cast("array<int>")) if ref is not None else F.array().cast("array<int>")
    frames = F.floor(F.size(flat) / N_LAYERS).cast("int")
    spk = spoken & (has_spk if isinstance(has_spk, Column) else F.lit(bool(has_spk)))
    using = spoken & (frames > 0) & (F.lit(True) if use_ref is None else use_ref)
    ref_start = F.when(using, F.greatest(spk.cast("int"), first - frames)).otherwise(first)
    kept = F.when(using, F.greatest(F.least(first - ref_start, frames), F.lit(0))).otherwise(F.lit(0))
    marker = (spk & (ref_start > 0)).cast("int")
    row = lambda *parts: F.slice(F.concat(*parts), 1, max_len)
    pads = lambda code, n: F.array_repeat(F.lit(code), n)
    inputs, labels = [], []

    def reference(j: int) -> Column:
        return F.filter(flat, lambda x, i: (i % N_LAYERS == j) & (i < frames * N_LAYERS) & (i >= (frames - kept) * N_LAYERS))

    for j in range(N_LAYERS):
        codes = F.when(spoken, F.get(_c(answer), F.lit(j))).otherwise(F.array().cast("array<int>"))
        inputs.append(row(pads(AUDIO_PAD, ref_start - marker), pads(AUDIO_SPK, marker), F.when(kept > 0, reference(j)).otherwise(F.array().cast("array<int>")),
                          pads(AUDIO_PAD, first - ref_start - kept + j + 1), codes, pads(AUDIO_PAD, F.lit(max_len))))
        labels.append(row(pads(-100, first + j + 1), codes, pads(-100, F.lit(max_len))))
    return F.struct(F.array(*inputs).alias("input"), F.array(*labels).alias("labels"))


def reference_draw(key, seed: int = 42) -> Column:
    """Q21: a reference is used with probability 0.5."""
    return keyed_uniform(key, "ref", seed) > 0.5


def shifted_rows(rows) -> tuple[Column, Column]:
    """Inputs without their last position, labels without their first."""
    cut = lambda name, at: F.transform(_c(rows)[name], lambda r: F.slice(r, at, F.size(r) - 1))
    return cut("input", 1), cut("labels", 2)


def undelay_frames(codes: DataFrame, key: str, start_col: str = "start", stop_from: int = 2048) -> DataFrame:
    """Q20: frame f = [layer l at step start+1+l+f]; frames are emitted only while every layer is before its
    first code >= 2048; codes >= 2049 become 0.  Long input ``(key, layer, pos, code)``."""
    rel = codes.withColumn("frame", F.col("pos") - F.col(start_col) - 1 - F.col("layer"))
    stops = rel.filter(F.col("code") >= stop_from).groupBy(key, "layer").agg(F.min("frame").alias("_stop"))
    j = rel.join(stops, [key, "layer"], "left")
    ok = j.filter(F.col("_stop").isNull() | (F.col("frame") < F.col("_stop")))
    fr = ok.groupBy(key, "frame").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("layer", F.when(F.col("code") >= 2049, F.lit(0))
                                              .otherwise(F.col("code")).alias("code")))).alias("_c"))
    return fr.filter(F.col("_n") == N_LAYERS).select(key, "frame", F.col("_c.code").alias("codes"))


def default_speaker_vector(v, dim: int = 192) -> Column:
    """Q24: missing or empty speaker embedding -> zeros."""
    v = _c(v)
    return F.when(F.coalesce(F.size(v), F.lit(0)) > 0, v).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))


def ranked_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], ties: list[str]) -> DataFrame:
    """(key, one column per share): linearly interpolated quantiles of ``value`` per key, nulls left out; ``ties`` order equal values.

    Rank r of n values stands at ``share * (n - 1)``; of all rows only the ranks below and above it take part."""
    ranked = number_within(df.where(F.col(value).isNotNull()).select(key, value, *ties), [key], [value, *ties], "_rank")
    ranked = with_group_count(ranked, [key], "_size")
    picks, out = [], []
    for name, share in shares.items():
        place = F.col("_size").cast("double") * share - share   # share * (n - 1)
        low = F.floor(place + 1e-9)
        high = F.least(low + 1, F.col("_size") - 1)
        picks += [F.max(F.when(F.col("_rank") == low, F.col(value))).alias(f"_{name}_low"),
                  F.max(F.when(F.col("_rank") == high, F.col(value))).alias(f"_{name}_high"),
                  F.max(F.greatest(place - low, F.lit(0.0))).alias(f"_{name}_part")]
        out.append((F.col(f"_{name}_low") + F.col(f"_{name}_part") * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))).alias(name))
    return ranked.groupBy(key).agg(*picks).select(key, *out)


def audio_quality(samples: DataFrame, key: str = "clip_id", pos: str = "pos", amp: str = "amp",
                  frame: int = 800, hop: int = 400, min_samples: int = 28800, quiet: float = 0.008,
                  noise_ratio: float = 0.45, peak_max: float = 0.995) -> DataFrame:
    """Frame RMS (frame/hop; one frame over the whole clip when shorter), linear-interpolated q95 and
    q20, peak; verdict ``too_short`` / ``too_quiet`` / ``noisy`` / ``clipped`` / ``ok`` in that order.
    Each sample is copied to the (at most frame/hop) frames that cover it, then one aggregation per frame.

    The quantiles are exact and no task holds a clip: frames are numbered by loudness inside their clip from a global sort
    (``number_within``), and the two ranks around each quantile are picked by an aggregation with map-side combine."""
    n = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs(amp)).alias("peak"))
    per = frame // hop
    s = samples.join(n, key)
    last = F.floor((F.col("_n") - frame) / hop)
    ks = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda d: F.floor(F.col(pos) / hop) - d)
    s = s.withColumn("k", F.explode(F.when(F.col("_n") >= frame, ks).otherwise(F.array(F.lit(0).cast("long")))))
    s = s.filter((F.col("_n") < frame) | ((F.col("k") >= 0) & (F.col("k") <= last) &
                                          (F.col(pos) < F.col("k") * hop + frame)))
    rms = s.groupBy(key, "k").agg(F.sqrt(F.avg(F.col(amp) * F.col(amp))).alias("rms"))
    q = ranked_quantiles(rms, key, "rms", {"q95": 0.95, "q20": 0.2}, ["k"])
    r = q.join(n, key)
    verdict = (F.when(F.col("_n") < min_samples, F.lit("too_short"))
               .when(F.col("q95") < quiet, F.lit("too_quiet"))
               .when((F.col("q95") > 0) & (F.col("q20") / F.col("q95") > noise_ratio), F.lit("noisy"))
               .when(F.col("peak") > peak_max, F.lit("clipped")).otherwise(F.lit("ok")))
    return r.select(key, F.col("_n").alias("n_samples"), "q95", "q20", "peak", verdict.alias("verdict"))


def keyed_normal(key, tag: str, seed: int = 42) -> Column:
    """A standard normal draw from two keyed uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - keyed_uniform(key, f"{tag}_r", seed))) * F.cos(2 * math.pi * keyed_uniform(key, f"{tag}_t", seed))


def augment_signal(arr, key, seed: int = 42, rate: int = 16000) -> Column:
    """G1 (array-simple part), in this order: noise of deviation U(0.001,0.01) with p=0.3, gain x U(0.8,1.2) with p=0.3, a silent quarter
    second with p=0.2 where there is more than a second (``rate`` samples), moving average k in {3,5,7} with p=0.2
    (zeros beyond the edges), clip to [-1, 1].  Draws are keyed by row, those of the noise by row and place."""
    a = _c(arr)
    by = _c(key)
    level = 0.001 + 0.009 * keyed_uniform(key, "noise", seed)
    a = F.when(keyed_uniform(key, "noise_p", seed) < 0.3, F.transform(a, lambda x, i: x + level * keyed_normal(
        F.concat_ws("/", by.cast("string"), i.cast("string")), "noise", seed))).otherwise(a)
    g_on = keyed_uniform(key, "gain_p", seed) < 0.3
    gain = F.when(g_on, 0.8 + 0.4 * keyed_uniform(key, "gain", seed)).otherwise(F.lit(1.0))
    a = F.transform(a, lambda x: x * gain)
    hush = rate // 4
    begin = F.floor(keyed_uniform(key, "hush", seed) * (F.size(_c(arr)) - hush + 1))
    a = F.when((keyed_uniform(key, "hush_p", seed) < 0.2) & (F.size(_c(arr)) > rate), F.transform(
        a, lambda x, i: F.when((i >= begin) & (i < begin + hush), F.lit(0.0)).otherwise(x))).otherwise(a)
    ma_on = keyed_uniform(key, "ma_p", seed) < 0.2
    k = (F.floor(keyed_uniform(key, "ma_k", seed) * 3) * 2 + 3).cast("int")
    half = (k - 1) / 2

    def smooth(arr_):
        n = F.size(arr_)
        return F.transform(arr_, lambda x, i: F.aggregate(
            F.slice(arr_, F.greatest(i - half, F.lit(0)).cast("int") + 1,
                    (F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1).cast("int")),
            F.lit(0.0), lambda s_, y: s_ + y) / k)

    from tessera.functions.arrays import let
    a = F.when(ma_on, let(a, smooth)).otherwise(a)
    return F.transform(a, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def mask_features(frames, n_dims: int, key, seed: int = 42, max_f: int = 64, max_t: int = 10) -> Column:
    """G2 on a flattened (T x n_dims) frame array: with p=0.5 zero f in [1,max_f] consecutive dims,
    with p=0.5 zero t in [1, min(max_t, T)] consecutive frames if there are at least two."""
    a = _c(frames)
    t_len = (F.size(a) / n_dims).cast("int")
    f_on = keyed_uniform(key, "fm_p", seed) < 0.5
    f = (F.floor(keyed_uniform(key, "fm_w", seed) * F.least(F.lit(max_f), F.lit(n_dims))) + 1).cast("int")
    f0 = F.floor(keyed_uniform(key, "fm_0", seed) * (F.lit(n_dims) - f + 1)).cast("int")
    t_on = (keyed_uniform(key, "tm_p", seed) < 0.5) & (t_len > 1)
    t = (F.floor(keyed_uniform(key, "tm_w", seed) * F.least(F.lit(max_t), t_len)) + 1).cast("int")
    t0 = F.floor(keyed_uniform(key, "tm_0", seed) * (t_len - t + 1)).cast("int")

    def zero(x, i):
        d, fr = i % n_dims, (i / n_dims).cast("int")
        hit = (f_on & (d >= f0) & (d < f0 + f)) | (t_on & (fr >= t0) & (fr < t0 + t))
        return F.when(hit, F.lit(0.0)).otherwise(x)

    return F.transform(a, zero)


def layered_loss(tokens: DataFrame, by: list[str], layer: str = "layer", target: str = "target",
                 loss: str = "loss", stop: int = AUDIO_STOP) -> DataFrame:
    """A10: per layer sum(loss * valid * (1 + 9*[target = stop])) / (sum(valid) + 1e-9), summed over
    layers that have a valid target, divided by 8.  ``target = -100`` marks an ignored position."""
    valid = (F.col(target) != -100).cast("double")
    w = valid * (1 + 9 * (F.col(target) == stop).cast("double"))
    per = tokens.groupBy(*by, layer).agg(F.sum(F.col(loss) * w).alias("_ws"), F.sum(valid).alias("_v"))
    per = per.filter(F.col("_v") > 0)
    return per.groupBy(*by).agg((F.sum(F.col("_ws") / (F.col("_v") + 1e-9)) / N_LAYERS).alias("audio_loss"))


def select_media(conv, question_audios, answer_audios, images, valid_lengths=None) -> Column:
    """Q25: the media a speech sample uses, by conversation position.  Question audio = item (#user - 1)
    when in range and non-empty; answer codes = item (#assistant - 1) when in range; image = the first.

    ``valid_lengths`` holds the valid frames of each question audio (its mask sum).  audio_length is that of the chosen one and
    audio_tokens the places it takes in the prompt, one at least; without an audio both are 0.  Missing media are null, for
    which the caller puts zeros."""
    c = _c(conv)
    n_user = F.size(F.filter(c, lambda m: m["role"] == "user"))
    n_asst = F.size(F.filter(c, lambda m: m["role"] == "assistant"))
    qa, aa, im = _c(question_audios), _c(answer_audios), _c(images)
    q = F.when((n_user > 0) & (n_user <= F.size(qa)), F.try_element_at(qa, n_user))
    q = F.when(F.coalesce(F.length(q), F.lit(0)) > 0, q)
    a = F.when((n_asst > 0) & (n_asst <= F.size(aa)), F.try_element_at(aa, n_asst))
    a = F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a)
    valid = F.lit(0) if valid_lengths is None else F.coalesce(F.try_element_at(_c(valid_lengths), F.greatest(n_user, F.lit(1))), F.lit(0))
    length = F.when(q.isNotNull(), valid).otherwise(F.lit(0)).cast("int")
    return F.struct(q.alias("question_audio"), a.alias("answer_codes"), F.try_element_at(im, F.lit(1)).alias("image"), length.alias("audio_length"),
                    F.when(q.isNotNull(), F.greatest(length, F.lit(1))).otherwise(F.lit(0)).alias("audio_tokens"))
