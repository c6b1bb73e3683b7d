"""Shared-folder tables, worker-side caches and small helpers of the ``llm`` operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one is set only where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tessera-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost executor
    costs nothing that was finished, and both sides of a later join are plain scans AQE may split."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tessera-llm/" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the rows that no label may be learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class BoundedCache(dict):
    """``dict`` that computes missing values.  The first ``cap`` keys stay, which are the frequent ones; later ones share
    a side table of ``cap // 4`` that starts anew when full.  Keys longer than ``longest`` are computed each time.

    Only speed depends on it, never a result.
    """

    def __init__(self, compute: Callable, cap: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.cap, self.longest, self.side = compute, cap, longest, {}

    def __missing__(self, key):
        value = self.side.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
            if len(self) < self.cap:
                self[key] = value
            else:
                if len(self.side) >= self.cap // 4:
                    self.side.clear()
                self.side[key] = value
        return value


_PER_WORKER: dict = {}


def per_worker(key, make: Callable, keep: int = 1):
    """One object per Python worker and key (a worker serves many tasks and stages); only the latest ``keep`` stay."""
    if key not in _PER_WORKER:
        while len(_PER_WORKER) >= keep:
            _PER_WORKER.pop(next(iter(_PER_WORKER)))
        _PER_WORKER[key] = make()
    return _PER_WORKER[key]


def row_chunks(batches: Iterator, columns: list[str], max_rows: int = 256) -> Iterator[list[list]]:
    """Columns of each Arrow batch as Python lists, few rows at a time: long texts don't pile up as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            part = batch.slice(at, max_rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def text_slices(batches: Iterator, column: str, most_bytes: int = 16 << 20) -> Iterator:
    """Slices of Arrow batches whose texts hold at most so many bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def crc32_u32(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF
