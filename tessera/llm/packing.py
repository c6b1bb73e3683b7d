"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of piece lengths (at most ``capacity`` rows) says all
the packing needs.  The driver plans on it; Spark numbers the pieces of each length and looks their places up.

Plan: pieces longer than ``small`` are cut into groups of equal cardinality by falling length and each is rounded up to
its group's longest, which leaves few sizes.  Configurations of those sizes (the largest size left plus the fullest
filling that the counts allow, found by a bounded knapsack) are taken as often as the counts permit.  Actual pieces
are substituted, longest first, in runs of equal lengths; their slack and then the small pieces are filled best-fit: each
length goes to the fullest sequences that still hold it, opening new ones only when none does.

Everything is kept as runs (so many sequences alike), so the plan's size follows the number of lengths, not of pieces.

Defined results: a null text counts as empty and is one piece, the end id; empty tables give empty results; repeated
doc_ids with different texts are packed as different documents, exact repeats too; clashing columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc32_u32, per_worker, row_chunks, text_of, written
from tessera.llm.encoding import ByteEncoder, ids_u32

CAPACITY = 2048
END = 0
GROUPS = (64, 512, CAPACITY)  # numbers of groups that are tried; the plan with the fewest sequences is taken
SMALL = 4  # pieces up to capacity / SMALL are small
BUCKET_ROWS = 4_000  # pieces numbered together

# ---- pieces ---------------------------------------------------------------------------------------------------------

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        encoder = per_worker(("ids", path), lambda: ByteEncoder(path, ids_u32, b"".join))
        end = ids_u32([END])
        for doc_ids, texts in row_chunks(batches, ["doc_id", "text"]):
            rows = []
            for doc, text in zip(doc_ids, texts):
                ids = b"".join(encoder.parts(text)) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1  # the first piece may be shorter
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    rows.append((doc, k, a, b - a, crc32_u32(part), part))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols[:n], types)], names[:n])
    return run


def pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``with_ids`` adds the ids as little-endian unsigned 32-bit integers."""
    rows = docs.select("doc_id", text_of(text).alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, with_ids), PIECE + (", ids binary" if with_ids else ""))


# ---- plan -----------------------------------------------------------------------------------------------------------


@dataclass
class Run:
    """``n`` sequences alike, numbered from ``base``; ``used`` of each is taken."""
    base: int
    n: int
    used: int


@dataclass
class Plan:
    """Place rows: the pieces of ``length`` ranked from ``rank`` on, ``per`` in each of ``n`` sequences from ``base`` on, the
    first at ``offset``."""
    rows: list = field(default_factory=list)
    sequences: int = 0
    ranks: dict = field(default_factory=dict)

    def place(self, length: int, n: int, per: int, base: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.rows.append((length, rank, rank + n * per, per, base, offset))
        self.ranks[length] = rank + n * per


def grouped(hist: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """Linear grouping of (length, count) by falling length: (rounded size, count) of about equal counts.

    A length is never split between groups of which one rounds it further than its own size."""
    total = sum(n for _, n in hist)
    out, room, size, held = [], max(1, -(-total // groups)), 0, 0
    for length, n in hist:
        if not held:
            size = length
        held += n
        if held >= room:
            out.append((size, held))
            held = 0
    if held:
        out.append((size, held))
    return out


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best: a bounded knapsack over bits, larger sizes preferred."""
    reach = [1]
    for size, count in zip(sizes, counts):
        bits, k, left = reach[-1], 1, min(count, room // size)
        while left:  # by powers of two, so a size takes few shifts
            take = min(k, left)
            bits |= bits << (take * size)
            left, k = left - take, 2 * k
        reach.append(bits & ((1 << (room + 1)) - 1))
    at, out = reach[-1].bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i] >> at & 1:
            at -= sizes[i]
            out[i] += 1
    return out


def configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(size index, how many)]): the largest size left, filled up as full as the counts allow."""
    left, out = [n for _, n in sizes], []
    while any(left):
        lead = next(i for i, n in enumerate(left) if n)
        room, usable = capacity - sizes[lead][0], left[:]
        usable[lead] -= 1
        take = fullest([s for s, _ in sizes], usable, room)
        take[lead] += 1
        times = min(left[i] // t for i, t in enumerate(take) if t)
        left = [n - times * t for n, t in zip(left, take)]
        out.append((times, [(i, t) for i, t in enumerate(take) if t]))
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups=GROUPS) -> Plan:
    return min((_plan(histogram, capacity, g) for g in groups), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int) -> Plan:
    plan, runs = Plan(), []
    hist = sorted(((size, n) for size, n in histogram.items() if n), reverse=True)
    for length, n in hist:
        if length == capacity:
            plan.place(length, n, 1, 0, 0)
            plan.sequences = n
    large = [(size, n) for size, n in hist if capacity // SMALL < size < capacity]
    sizes = grouped(large, groups)
    # each size's actual pieces in falling order, as a queue of (length, count)
    queues, it = [], iter(large)
    for _, n in sizes:
        own = []
        while n:
            length, k = next(it)
            own.append([length, k])
            n -= k
        queues.append(own[::-1])
    for times, config in configurations(sizes, capacity):
        slots = [i for i, t in config for _ in range(t)]
        # slots of one size take turns from its queue; a run ends where any slot's length does
        while times:
            n = times
            for i in set(slots):
                n = min(n, max(1, queues[i][-1][1] // slots.count(i)))  # 1: the slots' lengths may differ
            lengths = []
            for i in slots:
                q = queues[i]
                lengths.append(q[-1][0])
                q[-1][1] -= n
                if not q[-1][1]:
                    q.pop()
            offset = 0
            for length in lengths:
                plan.place(length, n, 1, plan.sequences, offset)
                offset += length
            runs.append(Run(plan.sequences, n, offset))
            plan.sequences += n
            times -= n
    _fill(plan, runs, [(size, n) for size, n in hist if size <= capacity // SMALL], capacity)
    return plan


def _fill(plan: Plan, runs: list[Run], small: list[tuple[int, int]], capacity: int) -> None:
    """Best fit of the small lengths, longest first; runs are kept by how full they are."""
    by_used: dict[int, list[Run]] = {}
    keys: list[int] = []

    def add(run: Run) -> None:
        if run.n and run.used < capacity:
            if run.used not in by_used:
                by_used[run.used] = []
                bisect.insort(keys, run.used)
            by_used[run.used].append(run)

    for r in runs:
        add(r)
    for length, count in small:
        while count:
            at = bisect.bisect_right(keys, capacity - length) - 1  # the fullest that still hold it
            if at < 0:
                per = capacity // length
                n = max(1, count // per)
                add(Run(plan.sequences, n, 0))
                plan.sequences += n
                continue
            used = keys[at]
            run = by_used[used].pop()
            if not by_used[used]:
                del by_used[used]
                keys.pop(at)
            per = min((capacity - used) // length, count)
            n = min(run.n, count // per)
            plan.place(length, n, per, run.base, used)
            add(Run(run.base + n, run.n - n, used))
            add(Run(run.base, n, used + per * length))
            count -= n * per


# ---- places ---------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, each piece's number among those of its length from 0, and keeps no length in one task.

    Pieces of a length are split by a hash into buckets of about ``BUCKET_ROWS`` rows of the table; a bucket
    numbers its own and starts after the buckets before it."""
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    cut = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (cut.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "bucket"])
            .withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first"))


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, groups=GROUPS) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32)."""
    spark = rows.sparkSession
    # at most `capacity` rows
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(histogram, capacity, groups)
    table: dict[int, list] = {}
    for length, lo, hi, per, base, offset in plan.rows:
        table.setdefault(length, []).append((lo, hi, per, base, offset))
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in table.items()})

    def look_up(batches):
        import pyarrow as pa
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                t = places.value[int(size)]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * size
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows).mapInArrow(look_up, PIECE + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes.  The pieces (a few numbers each) are written once, so the texts are
    encoded once."""
    return pack_pieces(written(pieces(docs, path, text, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (little-endian unsigned 32-bit), at most ``capacity`` each."""
    parts = pieces(docs, path, text, capacity, with_ids=True)
    same = ["doc_id", "piece", "ids_crc32"]
    packed = packed.select(*[F.col(c).alias(f"_{c}") for c in same], "sequence_id", "offset")
    joined = parts.dropDuplicates(same).join(packed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
