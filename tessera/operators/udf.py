"""User-function surface (U1-U4): user callables run inside Arrow-batched tasks.

Every hook takes a plain Python callable over pandas objects; Spark partitions the rows and ships
Arrow batches to it.  Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import rewards


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], cols: list[str], out: str = "score",
               bound: float | None = 3.0) -> DataFrame:
    """External scorer (e.g. a reward model) per (messages, answer) row, clipped to +-bound."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = pd.Series(fn(pdf[cols]), index=pdf.index).astype("float64")
            if bound is not None:
                s = s.clip(-bound, bound)
            pdf[out] = s
            yield pdf

    return df.mapInPandas(run, schema)


def register_arg_predicate(name: str, predicate: Callable[[Column], Column]) -> None:
    """Add or replace the argument check used by J3 for a tool name (a Column expression over the
    parsed argument map)."""
    rewards.ARG_PREDICATES[name] = predicate


def generate_with(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Pluggable rollout source -- a user batch generator from prompt rows to completion rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return prompts.mapInPandas(run, schema)


def process_media(col: Column | str, fn: Callable[[pd.Series], pd.Series], return_type: T.DataType) -> Column:
    """U4: a feature processor over a binary / array column, Arrow-batched."""
    udf = F.pandas_udf(lambda s: fn(s), return_type)
    return udf(F.col(col) if isinstance(col, str) else col)
