"""Provided parquet tables and a distributed row index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ship_package

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _materialise(df: DataFrame) -> DataFrame:
    """Write the id-tagged rows once (reliable checkpoint in the shared folder): they are read twice --
    for the per-partition counts and for the join back -- and both reads must see the same partition ids,
    which two separate executions (e.g. under different shuffle coalescing) would not guarantee."""
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_index(df: DataFrame, col: str = "row_index") -> DataFrame:
    """0-based position of each row in the DataFrame's current order, without a global window.

    Two passes: rows per partition (one row per partition -> a table bounded by the
    partition count, safe to broadcast), a prefix sum over it, then ``offset + local index``.
    Call it directly after the scan or sort whose order it should number.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)) \
                   .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    tagged = _materialise(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, F.col("_off") + F.col("_local"))
            .drop("_mid", "_pid", "_local", "_off"))


def with_file_order(scan: DataFrame, col: str = "row_index") -> DataFrame:
    """0-based position of each row of a file scan in the order of file path and place in the file; nothing is copied.

    Call it on the scan itself.  A scan's splits are the same each time it runs, so one pass over the metadata alone counts the rows
    of each (task, file) piece and a prefix sum over the pieces gives their first numbers.  The broadcast side has one row
    per piece, which the number of splits bounds.
    """
    mid = F.monotonically_increasing_id()
    tagged = scan.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), mid.alias("__mid"))
    tagged = tagged.withColumn("__task", F.shiftright("__mid", 33))
    piece = ["__task", "__path", "__block"]
    pieces = tagged.groupBy(*piece).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__least"))
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*piece, "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (tagged.join(F.broadcast(pieces), piece).withColumn(col, F.col("__before") + F.col("__mid") - F.col("__least"))
            .drop(*piece, "__mid", "__least", "__before"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the cluster has cores.

    On a cluster reading many files this is a no-op; it only helps a single-file (single row-group)
    input, where per-row CPU work (tokenising, rendering) would otherwise run in one task.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """0-based position of each row inside its key group, by ``order``, without one window per key.

    A global sort range-partitions the rows, so a hot key (say a third of all rows) is spread over many
    tasks.  Per (partition, key) the row count and first local index form a small table (one row per key
    and partition it touches); prefix sums over it give each piece's offset, joined back on
    (partition, key) -- a join key that a hot key does not skew.
    """
    tagged = df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)) \
                   .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    tagged = _materialise(tagged)
    pieces = tagged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (tagged.join(pieces, ["_pid", *keys])
            .withColumn(out, F.col("_off") + F.col("_local") - F.col("_first"))
            .drop("_mid", "_pid", "_local", "_first", "_off"))


def with_group_count(df: DataFrame, keys: list[str], out: str = "group_size") -> DataFrame:
    """Rows per key attached to each row (partial aggregation + join; no window per key)."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)
