"""Ordered per-key scans without per-group pandas overhead.

``groupBy().applyInPandas`` builds one pandas frame per group (milliseconds each); for many short
groups that dominates.  Here rows are hash-partitioned by key and sorted by (key, order) inside each
partition, and one ``mapInPandas`` pass walks the contiguous groups of each Arrow batch.  A group cut
by a batch boundary is held until it ends and joined once, so every call sees whole groups; memory per task
is bounded by one batch plus one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def group_bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Start offsets of each run of equal keys (plus the end) in a key-sorted frame."""
    n = len(pdf)
    if n == 0:
        return np.array([0])
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)


def sorted_group_scan(df: DataFrame, keys: list[str], order: list[str],
                      fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType,
                      num_partitions: int | None = None) -> DataFrame:
    """Apply ``fn(frame, bounds)`` to frames holding whole, key-sorted groups (``bounds`` = group starts + end)."""
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []   # pieces of the group that the last batch left open
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                edge = pd.concat([held[-1].iloc[-1:], pdf.iloc[[0, -1]]], ignore_index=True)
                if len(group_bounds(edge, keys)) == 2:   # all of the batch goes on with the open group
                    held.append(pdf)
                    continue
                pdf = pd.concat([*held, pdf], ignore_index=True)
            last = group_bounds(pdf, keys)[-2]
            done, held = pdf.iloc[:last].reset_index(drop=True), [pdf.iloc[last:].reset_index(drop=True)]
            if len(done):
                yield fn(done, group_bounds(done, keys))
        if held:
            rest = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            yield fn(rest, group_bounds(rest, keys))

    return ordered.mapInPandas(run, schema)
