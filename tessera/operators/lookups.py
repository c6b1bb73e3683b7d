"""J1 tool lookups as dimension joins, J6 registry upsert, J7 run/media pairing, J11 random pairing.

A lookup takes its dimension as a table; what a tool answers for unknown keys is the default of each value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rand import keyed_uniform


def lookup(calls: DataFrame, dim: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """The values of ``dim`` by ``keys`` (left equi-join), a default where the key is unknown, null or missing."""
    found = calls.drop(*defaults).join(dim.select(*keys, *defaults), keys, "left")
    return found.withColumns({name: F.coalesce(F.col(name), default) for name, default in defaults.items()})


def exchange_rate(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate by (from_currency, to_currency), default 1.0."""
    return lookup(calls, rates, ["from_currency", "to_currency"], {"rate": F.lit(1.0)})


def weather(calls: DataFrame, reports: DataFrame, temperature: str, condition: str) -> DataFrame:
    """Temperature and condition by location; the defaults are arguments."""
    return lookup(calls, reports, ["location"], {"temperature": F.lit(temperature), "condition": F.lit(condition)})


def current_time(calls: DataFrame, clocks: DataFrame, default_zone: str, default_time: str) -> DataFrame:
    """Datetime by timezone; a missing zone is the default zone, an unknown one has the default time."""
    zoned = calls.withColumn("timezone", F.coalesce("timezone", F.lit(default_zone)))
    return lookup(zoned, clocks, ["timezone"], {"datetime": F.lit(default_time)})


def translate(calls: DataFrame, phrases: DataFrame) -> DataFrame:
    """Translation by (text, target_language), default the text itself."""
    return lookup(calls, phrases, ["text", "target_language"], {"translated_text": F.col("text")})


def unit_convert(calls: DataFrame, factors: DataFrame) -> DataFrame:
    """Value times the factor of ``from_to`` (default 1), rounded half to even at 4 places."""
    key = F.concat(F.lower(F.coalesce("from_unit", F.lit(""))), F.lit("_"), F.lower(F.coalesce("to_unit", F.lit(""))))
    found = lookup(calls.withColumn("unit_key", key), factors, ["unit_key"], {"factor": F.lit(1.0)})
    return found.withColumn("result", F.bround(F.col("value").cast("double") * F.col("factor"), 4))


def registry_upsert(reg: DataFrame, updates: DataFrame, name: str = "name", grp: str = "grp",
                    deletes: DataFrame | None = None) -> DataFrame:
    """A name lives in exactly one group.  Groups load builtin, unseen, manual: the first load of a name stays,
    but manual overrides; deletes only remove manual entries.  Rows that tie are told apart by their columns, the least stays;
    a name with many rows is reduced before the shuffle."""
    prio = F.when(F.col(grp) == "manual", 3).when(F.col(grp) == "builtin", 2).otherwise(1)
    allr = reg.withColumn("_o", F.lit(0)).unionByName(updates.withColumn("_o", F.lit(1)))
    order = F.struct((-prio).alias("_p"), "_o", *reg.columns)
    best = allr.groupBy(name).agg(F.min(order).alias("_r"))
    out = best.select(*[F.col("_r").getField(c).alias(c) for c in reg.columns])
    if deletes is not None:
        gone = deletes.select(name).distinct().withColumn(grp, F.lit("manual"))
        out = out.join(gone, [name, grp], "left_anti").select(*reg.columns)
    return out


def pair_media_runs(runs: DataFrame, media: DataFrame, key: str = "sample_id", k: str = "k") -> DataFrame:
    """K-th placeholder run with the k-th media item; unmatched rows on either side are kept."""
    return runs.join(media, [key, k], "full_outer")


def pair_random(left: DataFrame, right: DataFrame, left_key: str, seed: int = 42) -> DataFrame:
    """Each left row draws one right row uniformly (with replacement) by a keyed uniform."""
    from tessera.sources.tables import with_row_index
    r = with_row_index(right, "_rn")
    from tessera.functions.arrays import scalar_of
    n = scalar_of(r.groupBy().agg(F.count(F.lit(1)).alias("_n")))["_n"]
    lft = left.withColumn("_rn", F.floor(keyed_uniform(left_key, "pair", seed) * n).cast("long"))
    return lft.join(r, "_rn").drop("_rn")
