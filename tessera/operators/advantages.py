"""Advantages, selection and loss diagnostics.

Group statistics are computed with ``groupBy`` (partial aggregation, safe for a hot group) and
joined back on the key, rather than with a window, so that no task has to hold a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import scalar_of
from tessera.functions.scan import sorted_group_scan


def _with_group_stats(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")


def _with_global_stats(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """Attach one-row global aggregates as a scalar subquery (computed once, no join)."""
    stats = df.groupBy().agg(*aggs)
    sc = scalar_of(stats)
    for c in stats.columns:
        df = df.withColumn(c, sc[c])
    return df


# ---- W1 --------------------------------------------------------------------------

def group_advantage(df: DataFrame, key: str = "prompt_id", reward: str = "reward", eps: float = 1e-4) -> DataFrame:
    """(r - mean) / (population std + eps) within each prompt's generations."""
    out = _with_group_stats(df, [key], [F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s")])
    return out.withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


# ---- W2 / A17 ----------------------------------------------------------------------

#: Rows of a sequence that one scan holds; a longer sequence is cut into pieces of as many positions.
GAE_PIECE = 4096


def _discounted(pdf: pd.DataFrame, bounds: np.ndarray, gamma: float, c: float, given: np.ndarray | None = None):
    """Advantages of whole runs of rows by windows of 1, 2, 4, ... rows, each made of two of half the length; a row that
    ``given`` marks ends its run and brings its advantage along.  Returns them and each row's last row."""
    v = pdf["v"].to_numpy(dtype=np.float64)
    last = np.repeat(bounds[1:] - 1, np.diff(bounds))
    at = np.arange(len(v))
    nxt = np.where(at < last, v[np.minimum(at + 1, len(v) - 1)], 0.0)
    adv = pdf["reward"].to_numpy(dtype=np.float64) + gamma * nxt - v
    if given is not None:
        adv[given] = pdf["advantage"].to_numpy(dtype=np.float64)[given]
    step = 1
    while step <= (last - at).max(initial=0):
        more = np.flatnonzero(at + step <= last)
        longer = adv.copy()
        longer[more] += c ** step * adv[more + step]
        adv, step = longer, 2 * step
    return adv, last


def _gae_heads(gamma: float, lam: float):
    """Each piece as its first row, with its advantage if nothing followed the piece, and the piece's length."""
    def fn(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        adv, _ = _discounted(pdf, bounds, gamma, gamma * lam)
        out = pdf.iloc[bounds[:-1]].copy()
        out["advantage"], out["length"] = adv[bounds[:-1]], np.diff(bounds)
        return out
    return fn


def _gae_links(gamma: float, lam: float):
    """A piece is an affine map: what follows (V, A) adds c^(n-1) (gamma V + c A) to its first advantage.  The maps are composed from
    the last piece of a sequence to the first; each first row then closes the piece before it."""
    c = gamma * lam

    def fn(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        adv = pdf["advantage"].to_numpy(dtype=np.float64).copy()
        v, n, piece = (pdf[x].to_numpy() for x in ("v", "length", "piece"))
        before = np.zeros(len(pdf), np.int64)
        for start, end in zip(bounds[:-1], bounds[1:]):
            for i in range(end - 2, start - 1, -1):
                adv[i] += c ** (int(n[i]) - 1) * (gamma * v[i + 1] + c * adv[i + 1])
            before[start + 1:end] = piece[start:end - 1]
        out = pdf.drop(columns=["length"])
        out["advantage"], out["piece"] = adv, before
        return out
    return fn


def _gae_rows(gamma: float, lam: float):
    def fn(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        given = pdf["advantage"].notna().to_numpy()
        adv, _ = _discounted(pdf, bounds, gamma, gamma * lam, given)
        out = pdf.drop(columns=["v", "reward", "piece"])
        out["advantage"], out["ret"] = adv, adv + pdf["v"].to_numpy(dtype=np.float64)
        return out[~given].reset_index(drop=True)
    return fn


def gae(tokens: DataFrame, keys: tuple[str, ...] = ("prompt_id", "gen_id"), gamma: float = 1.0,
        lam: float = 0.95, mask: str | None = "mask", piece: int = GAE_PIECE) -> DataFrame:
    """Generalised advantage estimation per sequence, ``A_t = delta_t + gamma*lam*A_{t+1}``,
    ``delta_t = r_t + gamma*V_{t+1} - V_t``; V counts as 0 outside the response mask and after the end.

    A sequence is cut into pieces of ``piece`` positions, so a long one spans many tasks.  The first rows of all pieces but the
    first of each sequence are brought together per sequence (one row a piece) and composed from the end; each then joins the
    rows of the piece before it as that piece's last row, so that rows are shuffled once, by (sequence, piece), sorted by position and
    scanned (``sorted_group_scan``).  Sequences within one piece cost nothing more.  The closed form
    ``sum(delta*c^k)/c^t`` is avoided because c^k underflows on long sequences.
    """
    keys = list(keys)
    extra = [c for c in tokens.columns if c not in [*keys, "pos", "v", "reward"]]
    v = F.col("v") * F.col(mask) if mask in tokens.columns else F.col("v")
    data = tokens.select(*keys, "pos", *extra, v.cast("double").alias("v"), F.col("reward").cast("double").alias("reward"),
                         F.floor(F.coalesce(F.col("pos"), F.lit(0)) / piece).cast("long").alias("piece"))
    headed = data.withColumn("advantage", F.lit(None).cast("double")).schema
    heads = sorted_group_scan(data.where(F.col("piece") > 0), [*keys, "piece"], ["pos"], _gae_heads(gamma, lam),
                              data.withColumn("advantage", F.lit(None).cast("double")).withColumn("length", F.lit(0).cast("long")).schema)
    closing = sorted_group_scan(heads, keys, ["piece"], _gae_links(gamma, lam), headed)
    rows = data.withColumn("advantage", F.lit(None).cast("double")).unionByName(closing)
    schema = tokens.select(*keys, "pos", *extra).schema.add("advantage", "double").add("ret", "double")
    return sorted_group_scan(rows, [*keys, "piece"], ["pos"], _gae_rows(gamma, lam), schema)


# ---- A17 ----------------------------------------------------------------------------

def whiten(df: DataFrame, col: str = "advantage", mask: str = "mask", out: str | None = None) -> DataFrame:
    """Masked global mean / population variance, ``(a - m) * (var + 1e-8)^-1/2 * mask``.

    One pass for the three masked sums (partial aggregation), one broadcast join of the 1-row result.
    Callers should persist an expensive ``df`` since it is read twice.
    """
    out = out or f"{col}_white"
    a, m = F.col(col), F.col(mask)
    den = F.greatest(F.sum(m), F.lit(1))
    stats = [(F.sum(a * m) / den).alias("_m"), (F.sum(a * a * m) / den).alias("_a2"), (F.sum(m) / den).alias("_w")]
    s = _with_global_stats(df, stats)
    var = F.col("_a2") - 2 * F.col("_m") * F.col("_m") + F.col("_m") * F.col("_m") * F.col("_w")
    return s.withColumn(out, (a - F.col("_m")) * F.pow(var + 1e-8, -0.5) * m).drop("_m", "_a2", "_w")


# ---- W3 / W4 / W5 --------------------------------------------------------------------

def top_k(scored: DataFrame, k: int = 50, key: str = "grp", score: str = "score", item: str = "item",
          salt_buckets: int | None = None) -> DataFrame:
    """Per group keep the items whose score is >= the k-th largest (ties kept).

    Two steps so a hot group is never ranked in one task: rank inside (group, salt) buckets and keep
    rank <= k (a superset of the answer), then rank the <= salt_buckets*k survivors per group.  The number of buckets
    follows the session's shuffle partitions unless given.
    """
    salt_buckets = salt_buckets or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(item), F.lit(salt_buckets))
    b = scored.withColumn("_salt", salt)
    w1 = Window.partitionBy(key, "_salt").orderBy(F.col(score).desc())
    cand = b.withColumn("_r", F.rank().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(key).orderBy(F.col(score).desc())
    return cand.withColumn("rank", F.rank().over(w2)).filter(F.col("rank") <= k)


def cumulative_mass(scored: DataFrame, p: float, key: str = "grp", score: str = "score",
                    item: str = "item") -> DataFrame:
    """Softmax per group, sort by score desc (item asc on ties), keep items while the mass
    before them is <= p (the item that crosses p is kept; the first is always kept)."""
    st = scored.groupBy(key).agg(F.max(score).alias("_mx"))
    e = scored.join(st, key).withColumn("_e", F.exp(F.col(score) - F.col("_mx")))
    tot = e.groupBy(key).agg(F.sum("_e").alias("_z"))
    e = e.join(tot, key).withColumn("prob", F.col("_e") / F.col("_z"))
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item).asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("mass_before", F.coalesce(F.sum("prob").over(w), F.lit(0.0)))
    return e.filter(F.col("mass_before") <= p).drop("_mx", "_e", "_z")


def center_features(frames: DataFrame, keys: list[str], value: str = "value", floor: float = 1e-10) -> DataFrame:
    """log(clamp(x, floor)) minus its mean per (utterance, dimension) key."""
    lg = frames.withColumn("_lg", F.log(F.greatest(F.col(value), F.lit(floor))))
    return _with_group_stats(lg, keys, [F.avg("_lg").alias("_mu")]) \
        .withColumn("centered", F.col("_lg") - F.col("_mu")).drop("_lg", "_mu")


# ---- A8 / A9 / A11 / A12 / A13 -----------------------------------------------------------

def reward_report(df: DataFrame, by: list[str], key: str = "prompt_id", reward: str = "reward",
                  advantage: str = "advantage", length: str | None = None) -> DataFrame:
    """Mean reward, mean per-prompt population std, advantage mean / sample std, mean length."""
    per = df.groupBy(*by, key).agg(F.stddev_pop(reward).alias("_gs"))
    g = per.groupBy(*by).agg(F.avg("_gs").alias("mean_group_std"))
    aggs = [F.avg(reward).alias("mean_reward"), F.avg(advantage).alias("adv_mean"),
            F.stddev_samp(advantage).alias("adv_std"), F.count(F.lit(1)).alias("n")]
    if length:
        aggs.append(F.avg(length).alias("mean_length"))
    main = df.groupBy(*by).agg(*aggs)
    if by:
        return main.join(g, by, "left")
    return main.withColumn("mean_group_std", scalar_of(g)["mean_group_std"])


def masked_loss(tokens: DataFrame, by: list[str], seq_keys: list[str], loss: str = "loss",
                mask: str = "mask") -> DataFrame:
    """The four normalisations of a masked per-token loss."""
    lm = F.col(loss) * F.col(mask)
    per_seq = tokens.groupBy(*by, *seq_keys).agg(F.sum(lm).alias("_ls"), F.sum(mask).alias("_ms"))
    seq = per_seq.groupBy(*by).agg(
        F.avg(F.col("_ls") / F.greatest(F.col("_ms"), F.lit(1))).alias("seq_mean"),
        F.avg(F.when(F.col("_ms") > 0, F.col("_ls") / F.col("_ms"))).alias("seq_mean_nonempty"),
        F.try_divide(F.sum("_ls"), F.sum("_ms")).alias("token_mean"),   # null without a valid token
        (F.sum("_ls") / (F.sum("_ms") + 1e-8)).alias("token_mean_eps"))
    return seq


def log_sigmoid(x: Column) -> Column:
    """Numerically stable log(sigmoid(x)) = -log1p(exp(-x)), branching on the sign."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def masked_logp_sums(tokens: DataFrame, pair: list[str], side: str = "chosen", policy: str = "lp_new", ref: str = "lp_ref",
                     mask: str = "mask") -> DataFrame:
    """A11 from per-token log-probabilities: masked sums of each side of a pair as pc, pr, rc, rr.  ``side`` is true on the
    chosen side; a pair lacking a side has null sums.  One partial aggregation, no join."""
    def total(c, chosen):
        return F.sum(F.when(F.col(side) == F.lit(chosen), F.col(c) * F.col(mask)))

    return tokens.groupBy(*pair).agg(total(policy, True).alias("pc"), total(policy, False).alias("pr"),
                                     total(ref, True).alias("rc"), total(ref, False).alias("rr"))


def preference_loss(pairs: DataFrame, beta: float = 0.15, pc: str = "pc", pr: str = "pr", rc: str = "rc",
                    rr: str = "rr") -> DataFrame:
    """``-logsigmoid(beta * ((pi_c - pi_r) - (ref_c - ref_r)))`` per pair (masked logp sums given)."""
    margin = (F.col(pc) - F.col(pr)) - (F.col(rc) - F.col(rr))
    return pairs.withColumn("margin", margin).withColumn("loss", -log_sigmoid(F.lit(beta) * F.col("margin")))


def token_ratios(tokens: DataFrame, new: str = "lp_new", old: str = "lp_old", ref: str = "lp_ref") -> DataFrame:
    lr = F.col(new) - F.col(old)
    d = F.col(ref) - F.col(new)
    return (tokens.withColumn("ratio", F.exp(lr))
            .withColumn("kl_k3", F.exp(d) - d - 1)
            .withColumn("approx_kl", 0.5 * lr * lr))


def policy_diagnostics(tokens: DataFrame, by: list[str], mask: str = "mask", clip_eps: float = 0.2) -> DataFrame:
    """Token-weighted ratio, k3 KL to the reference, approximate KL and clip fraction."""
    t = token_ratios(tokens)
    m = F.col(mask)
    den = F.greatest(F.sum(m), F.lit(1))
    return t.groupBy(*by).agg(
        (F.sum(F.col("ratio") * m) / den).alias("mean_ratio"),
        (F.sum(F.col("kl_k3") * m) / den).alias("kl_ref"),
        (F.sum(F.col("approx_kl") * m) / den).alias("approx_kl"),
        (F.sum((F.abs(F.col("ratio") - 1) > clip_eps).cast("double") * m) / den).alias("clip_frac"),
        F.sum(m).alias("n_tokens"))


def token_kl(tokens: DataFrame, by: list[str], mask: str = "mask") -> DataFrame:
    """Token-weighted mean of ref minus new log-probability."""
    gap = (F.col("lp_ref") - F.col("lp_new")) * F.col(mask)
    return tokens.groupBy(*by).agg((F.sum(gap) / F.greatest(F.sum(mask), F.lit(1))).alias("kl"))


def ppo_objective(tokens: DataFrame, by: list[str], adv: str = "advantage", value: str = "value", old_value: str = "old_value",
                  ret: str = "ret", mask: str = "mask", clip_eps: float = 0.2, clip_value: float = 0.2,
                  kl_coef: float = 0.02) -> DataFrame:
    """The clipped policy loss plus ``kl_coef`` times the k3 KL, and the clipped value loss, each a mean over all
    valid tokens of a group (not over sequences)."""
    t = token_ratios(tokens)
    m, a, r = F.col(mask), F.col(adv), F.col("ratio")
    bounded = F.greatest(F.lit(1 - clip_eps), F.least(F.lit(1 + clip_eps), r))
    near = F.greatest(F.col(old_value) - clip_value, F.least(F.col(old_value) + clip_value, F.col(value)))
    worse = F.greatest(F.pow(F.col(value) - F.col(ret), 2), F.pow(near - F.col(ret), 2))
    n = F.greatest(F.sum(m), F.lit(1))
    return t.groupBy(*by).agg(
        (F.sum(F.greatest(-a * r, -a * bounded) * m) / n + kl_coef * F.sum(F.col("kl_k3") * m) / n).alias("policy_loss"),
        (0.5 * F.sum(worse * m) / n).alias("value_loss"))


def policy_loss_terms(tokens: DataFrame, adv: str = "advantage", beta: float = 0.1, eps: float = 0.2,
                      eps_high: float = 5.0, clip_eps: float = 0.2) -> DataFrame:
    """Per-token losses for the three objectives (cispo, grpo, ppo)."""
    t = token_ratios(tokens)
    r, a, kl = F.col("ratio"), F.col(adv), F.col("kl_k3")
    clipped = F.greatest(F.lit(1 - eps), F.least(F.lit(1 + eps), r))
    t = t.withColumn("loss_cispo", -(F.least(r, F.lit(eps_high)) * a * F.col("lp_new") - beta * kl))
    t = t.withColumn("loss_grpo", -(F.least(r * a, clipped * a) - beta * kl))
    pclip = F.greatest(F.lit(1 - clip_eps), F.least(F.lit(1 + clip_eps), r))
    return t.withColumn("loss_ppo", F.greatest(-a * r, -a * pclip))
