"""Exact duplicates by a heavy-hitter split.

Two texts are equal if they are the same after each run of ``[\\x20\\x09-\\x0D]`` became one space; the sha256 of that text
stands for it.  A group may hold a third of all rows, so the digests are split before anything is shuffled by digest:

1. Each partition of the digests keeps a Misra-Gries summary of ``COUNTERS`` counters; summaries add up by digest.  Every
   digest of more than 1 / (COUNTERS + 1) of the rows is among the ``COUNTERS`` largest sums (summaries are mergeable).
2. Those candidates are verified by an exact count (partial aggregation, at most ``COUNTERS`` groups).  The winners, with their group
   size and the row that stays, are at most ``COUNTERS`` rows and broadcast: their copies are settled on the map side.
3. All other digests, none of which is frequent now, go through an ordinary shuffle.

The texts are read once; what is written and shuffled is (doc_id, 32 bytes, row).

Defined results: null counts as empty, empty texts are equal to each other, texts of white space alone equal one space; texts of any
length are one row; of equal texts the row with the smallest doc_id stays, null ids come last; among repeated rows of that
id exactly one is kept; empty tables give empty results; columns that clash with the result's are left out of ``classes`` and
returned untouched by ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of, written

#: Counters of a summary, so a bound on the broadcast rows too.
COUNTERS = 1000
BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text: str | Column = "text") -> Column:
    """32 bytes that stand for the text with its white space made even."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), BLANKS, " ").cast("binary"), 256))


def reduce_counters(counts: dict, most: int) -> dict:
    """The Misra-Gries step for many at once: subtract the (most + 1)-th largest count from all, keep what stays positive."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return {k: n - cut for k, n in counts.items() if n > cut}


def summaries(digests: DataFrame, most: int) -> DataFrame:
    """At most ``most`` (digest, n) rows per partition; n is short of the true count by at most rows / (most + 1)."""
    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        counts: dict = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for digest, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                counts[digest] = counts.get(digest, 0) + n
            counts = reduce_counters(counts, most)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return digests.select("digest").mapInArrow(summarise, "digest binary, n long")


def heavy_hitters(digests: DataFrame, most: int = COUNTERS) -> DataFrame:
    """Candidates: at most ``most`` digests, with every one that more than rows / (most + 1) rows hold."""
    sums = summaries(digests, most).groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.orderBy(F.desc("n"), "digest").limit(most).select("digest")


def _groups(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first)


def _settled(docs: DataFrame, text: str, most: int) -> DataFrame:
    """doc_id, digest, row, group_size, first (struct of the row that stays) of each row."""
    rows = docs.select("doc_id", digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "exact-digests")
    candidates = F.broadcast(heavy_hitters(rows, most))
    exact = _groups(rows.join(candidates, "digest", "left_semi"))
    winners = F.broadcast(written(exact.where(F.col("group_size") * (most + 1) > rows.count()), "exact-winners"))
    frequent = rows.join(winners, "digest")
    others = rows.join(winners, "digest", "left_anti")
    return frequent.unionByName(others.join(_groups(others), "digest"))


def classes(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``."""
    return _settled(docs, text, counters).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns.

    Copies of frequent texts are removed on the map side by the broadcast winners; the rest meet the list of (digest, doc_id) to
    keep.  Rows that repeat both are reduced to one by an aggregation that holds a single row per group.
    """
    settled = _settled(docs, text, counters)
    stay = settled.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    stay = stay.select(F.col("digest").alias("k_digest"), F.col("doc_id").alias("k_id"), "n")
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").alias("r_id"), digest_of(text).alias("r_digest"))
    met = rows.join(stay, (F.col("r_digest") == F.col("k_digest")) & F.col("r_id").eqNullSafe(F.col("k_id")))
    once = met.where("n = 1").select("own")
    several = met.where("n > 1").groupBy("r_digest", "r_id").agg(F.min_by("own", F.xxhash64("own")).alias("own")).select("own")
    return once.unionByName(several).select("own.*")
