"""RL step analytics: rollouts -> rewards -> advantages -> policy diagnostics.

Rollouts and per-token tables are inputs (the reference's rollout engines are not rebuilt).
One equi-join on ``prompt_id`` attaches tasks; group statistics are groupBy + join on the same key.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import advantages as adv
from tessera.operators import rewards as rw


def r6(c) -> F.Column:
    """Round to 6 places for cross-engine comparison: a 1e-9 nudge resolves exact decimal ties the same
    way in every engine whatever the last-bit float noise, and -0.0 becomes 0.0."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6) + F.lit(0.0)


def agent_rewards(rollouts: DataFrame, tasks: DataFrame, turns: str | None = None) -> DataFrame:
    df = rw.agent_reward(rw.attach_task(rollouts, tasks), turns=turns)
    return df.select("prompt_id", "gen_id", F.col("n_calls").cast("long").alias("n_calls"),
                     F.col("n_valid").cast("long").alias("n_valid"), F.col("n_matched").cast("long").alias("n_matched"),
                     r6("reward").alias("reward"))


def chat_rewards(rollouts: DataFrame, scores: DataFrame, key: str = "prompt_id") -> DataFrame:
    """A7 + J4 + W1: format/repetition reward plus clipped external score, then group advantage."""
    df = rw.chat_reward(rollouts)
    df = rw.merge_model_scores(df, scores, key)
    df = adv.group_advantage(df, key)
    return df


def gae_whiten(tokens: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    g = adv.gae(tokens.select("prompt_id", "gen_id", "pos", "v", "reward", "mask"), gamma=gamma, lam=lam)
    g = g.persist(StorageLevel.MEMORY_AND_DISK)     # read twice: global stats, then the normalisation
    w = adv.whiten(g, "advantage", "mask", "advantage_white")
    return w.select("prompt_id", "gen_id", F.col("pos").cast("long").alias("pos"), r6("advantage").alias("advantage"),
                    r6("ret").alias("ret"), r6("advantage_white").alias("advantage_white"))


def sequence_advantages(tokens: DataFrame) -> DataFrame:
    """Per-sequence reward (sum over tokens) -> group advantage within the prompt."""
    seq = tokens.groupBy("prompt_id", "gen_id").agg(F.sum("reward").alias("reward"))
    return adv.group_advantage(seq, "prompt_id").select("prompt_id", "gen_id", "advantage")


def policy_losses(tokens: DataFrame, beta: float = 0.1) -> DataFrame:
    """A13 with A9's per-sequence normalisation: mean over sequences of the masked token mean."""
    tokens = tokens.persist(StorageLevel.MEMORY_AND_DISK)     # read twice: per-sequence rewards and the losses
    t = tokens.join(sequence_advantages(tokens), ["prompt_id", "gen_id"])
    t = adv.policy_loss_terms(t, "advantage", beta=beta)
    m = F.col("mask")
    per_seq = t.groupBy("prompt_id", "gen_id").agg(
        *[(F.sum(F.col(f"loss_{k}") * m) / F.greatest(F.sum(m), F.lit(1))).alias(k) for k in ("cispo", "grpo", "ppo")])
    return per_seq.groupBy("prompt_id").agg(*[r6(F.avg(k)).alias(f"loss_{k}") for k in ("cispo", "grpo", "ppo")])
