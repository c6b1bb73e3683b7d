"""Keyed uniform draws: same row -> same draw, whatever the partitioning.

u(key, tag, seed) = first 32 bits of md5("key:tag:seed") / 2^32.
The same formula is written in DuckDB as
``('0x'||substr(md5(key||':'||tag||':'||seed),1,8))::bigint/4294967296.0``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column | str, tag: str, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{tag}:{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_choice(u: Column, outcomes: Sequence, weights: Sequence[float]) -> Column:
    """``when`` ladder over cumulative weights on one uniform draw."""
    total = float(sum(weights))
    acc = 0.0
    expr = None
    for value, w in zip(outcomes[:-1], weights[:-1]):
        acc += w / total
        expr = F.when(u < acc, F.lit(value)) if expr is None else expr.when(u < acc, F.lit(value))
    last = F.lit(outcomes[-1])
    return last if expr is None else expr.otherwise(last)
