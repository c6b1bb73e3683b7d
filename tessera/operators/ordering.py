"""Reproducible ordering, sharding and batching (L1-L5) without a global window.

A seeded permutation is a sort on ``md5(id:seed)`` (range partitioning, so it scales), and
positions come from per-partition counts plus prefix offsets (``with_row_index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import scalar_of
from tessera.sources.tables import with_row_index


def epoch_shuffle(df: DataFrame, id_col: str, epoch: int, seed: int = 42) -> DataFrame:
    """L1: rows in a seeded permutation (seed + epoch); adds 0-based ``pos``.

    Only the ids are sorted and numbered; the other columns are joined to their positions by the id, which must be
    unique."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed + epoch}")))
    ids = df.select(id_col).withColumn("_h", h).orderBy("_h", id_col).drop("_h")
    places = with_row_index(ids, "pos")
    out = places if df.columns == [id_col] else df.join(places, id_col)
    return out.withColumn("epoch", F.lit(epoch))


def _with_count(df: DataFrame, name: str = "_n") -> DataFrame:
    """Row count attached as a scalar subquery (no join)."""
    return df.withColumn(name, scalar_of(df.groupBy().agg(F.count(F.lit(1)).alias(name)))[name])


def shard_by_rank(df: DataFrame, world: int, pos: str = "pos") -> DataFrame:
    """L2: rank = pos mod world after padding to a multiple of world by going round from the start, as often as
    needed; adds ``shard``, ``local_pos`` and ``shard_size`` (the same for all shards).  One count serves all rows; a row
    repeats itself in place."""
    c = _with_count(df)
    n, p = F.col("_n"), F.col(pos)
    total = F.expr(f"(_n + {world - 1}) div {world} * {world}")
    again = F.sequence(p, total - 1, n)     # p, p + n, p + 2n, ... below the total
    both = c.withColumn(pos, F.explode(again))
    return (both.withColumn("shard", F.pmod(F.col(pos), F.lit(world)).cast("int"))
            .withColumn("local_pos", F.expr(f"{pos} div {world}"))
            .withColumn("shard_size", F.expr(f"(_n + {world - 1}) div {world}")).drop("_n"))


def assign_batches(df: DataFrame, batch_size: int, skip: int = 0, pos: str = "pos",
                   size: str | None = None) -> DataFrame:
    """L3: consecutive batches of ``batch_size``, of a table or, with ``size`` naming the column of a row's shard size, of
    each shard; the first ``skip`` full batches are dropped and the final
    partial batch is kept only when the skip was used up.  ``batch_id`` counts the yielded batches."""
    d = df.withColumnRenamed(size, "_n") if size else _with_count(df)
    b = F.expr(f"{pos} div {batch_size}")
    full_batches = F.expr(f"_n div {batch_size}")
    is_full = b < full_batches
    keep = (b >= skip) & (is_full | (full_batches >= skip))
    return d.withColumn("batch_id", (b - skip).cast("long")).filter(keep).drop("_n")


def cap_samples(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """L4: the first n rows by position."""
    return df.filter(F.col(pos) < n)


def cap_from_steps(max_steps: int, done_steps: int, batch_size: int) -> int:
    """L4: samples still needed when training is capped by steps."""
    return max(0, max_steps - done_steps) * batch_size
