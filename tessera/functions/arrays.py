"""Array-expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it (as a lambda variable) inside ``body``.

    An outer expression referenced inside a higher-order function's lambda is re-evaluated for every
    element; binding it through a one-element ``transform`` evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def scalar_of(stats) -> Column:
    """A one-row aggregate DataFrame as a struct-valued scalar subquery: Spark runs it once and hands the
    value to every task, with no join (the one-row result is the size bound)."""
    return stats.select(F.struct(*stats.columns)).scalar()
