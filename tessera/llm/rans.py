"""Token ids as range asymmetric numeral system (rANS) segments.

A segment holds whole documents, about ``SEGMENT`` ids.  One frequency table, scaled to 2**20, is shared by all its blocks.  A
block of 32,768 ids is coded on its own by 32 interleaved lanes (id i belongs to lane i mod 32) and has a CRC-32 of
its ids.  Every 256 steps a checkpoint keeps the place in the block's words and the lanes' states, so
each stretch between checkpoints can be decoded by itself, and all stretches of a segment are decoded at once, as rows
of one array.

Files: Parquet rows (part, segment, doc_ids, lengths, payload), uncompressed; ``part`` and ``segment`` order the segments by
ascending doc_id.  Payload, little-endian: magic ``TRS1``; u32 ids, blocks, symbols, bytes of the packed table; the table (zlib of
the byte planes of u32 symbol differences, then frequencies); per block u32 ids, words, CRC-32; then per block its checkpoints (u32 word, 32 u64
states, first one at word 0) and its u32 words.

Defined results: null and empty texts hold the end id only; null doc_ids come first; repeated rows are all written, ties
in doc_id in the order of their text; an empty table gives no file rows and no result rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc32_u32, per_worker, row_chunks, scratch_path, text_of, text_slices
from tessera.llm.encoding import WordEncoder, ids_u16, ids_u32, u32

BITS = 20
LANES, STEPS, CHECK = 32, 1024, 256
BLOCK = LANES * STEPS
SEGMENT = 1 << 22
LOW = np.uint64(1 << 31)
MAGIC = b"TRS1"
END = 2


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**BITS, at least 1 each, near the counts' shares."""
    total = 1 << BITS
    f = np.maximum(1, np.rint(counts * (total / counts.sum()))).astype(np.int64)
    over = int(f.sum()) - total
    while over > 0:  # take from the largest, never below 1
        big = np.argsort(-f, kind="stable")
        for i in big:
            cut = min(over, int(f[i]) // 2)
            f[i] -= cut
            over -= cut
            if not over:
                break
    if over < 0:
        f[f.argmax()] -= over
    return f


def _planes(values: np.ndarray) -> bytes:
    """u32 values by byte plane, which packs better."""
    return np.frombuffer(u32(values), np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _step(t: np.ndarray, blocks: int, pad: int) -> np.ndarray:
    """The ids as (steps, blocks * lanes); missing ones at the end are ``pad`` and dropped after decoding."""
    full = np.full(blocks * BLOCK, pad, t.dtype)
    full[:len(t)] = t
    return full.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, blocks * LANES)


def encode(ids: np.ndarray) -> bytes:
    """A segment's payload."""
    every = np.bincount(ids)
    symbols = np.flatnonzero(every)
    number = np.zeros(len(every), np.int32)
    number[symbols] = np.arange(len(symbols))
    t, counts = number[ids], every[symbols]
    freq = scaled(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    steps = _step(t, blocks, int(freq.argmax()))
    width, shift, word = blocks * LANES, np.uint64(BITS), np.uint64(32)
    state = np.full(width, LOW, np.uint64)
    small = np.min_scalar_type(blocks)  # narrow numbers, which sort by radix
    lane_block = np.repeat(np.arange(blocks, dtype=small), LANES)
    words, owners, checks, ends = [], [], [], []
    top = np.uint64(63 - BITS)
    for s in range(STEPS - 1, -1, -1):
        f = f64[steps[s]]
        out = np.flatnonzero(state >= f << top)
        if len(out):
            words.append(state[out].astype(np.uint32))
            owners.append(lane_block[out])
            state[out] >>= word
        else:
            words.append(np.empty(0, np.uint32))
            owners.append(np.empty(0, small))
        q = state // f
        state = (q << shift) + (state - q * f) + c64[steps[s]]
        if s % CHECK == 0:
            checks.append(state.copy())
            ends.append(len(words))
    words, owners = words[::-1], owners[::-1]
    flat, owner = np.concatenate(words), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    per_block = np.bincount(owner, minlength=blocks)
    first = np.concatenate([[0], np.cumsum(per_block)])
    # words of each block before each checkpoint
    at = [np.zeros(blocks, np.int64)]
    for k in range(STEPS // CHECK - 1):
        at.append(at[-1] + np.bincount(np.concatenate(owners[k * CHECK:(k + 1) * CHECK]), minlength=blocks))
    checks = checks[::-1]
    table = zlib.compress(_planes(np.concatenate([np.diff(symbols, prepend=0), freq])), 6)
    out = [MAGIC, struct.pack("<IIII", len(ids), blocks, len(symbols), len(table)), table]
    for b in range(blocks):
        part = ids[b * BLOCK:(b + 1) * BLOCK]
        out.append(struct.pack("<III", len(part), per_block[b], crc32_u32(u32(part))))
    flat = flat[order]
    for b in range(blocks):
        for k in range(STEPS // CHECK):
            out.append(struct.pack("<I", at[k][b]))
            out.append(checks[k][b * LANES:(b + 1) * LANES].astype("<u8").tobytes())
        out.append(flat[first[b]:first[b + 1]].astype("<u4").tobytes())
    return b"".join(out)


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload; raises ValueError on a wrong magic, a cut payload or a checksum that doesn't hold."""
    if payload[:4] != MAGIC:
        raise ValueError("no segment")
    n, blocks, n_symbols, n_table = struct.unpack_from("<IIII", payload, 4)
    try:
        raw = _unplanes(zlib.decompress(payload[20:20 + n_table]))
        symbols, freq = np.cumsum(raw[:n_symbols], dtype=np.int64).astype(np.uint32), raw[n_symbols:].astype(np.int64)
        if int(freq.sum()) != 1 << BITS:
            raise ValueError("table")
        heads = [struct.unpack_from("<III", payload, 20 + n_table + 12 * b) for b in range(blocks)]
        per = STEPS // CHECK
        state, place, words, at, before = [], [], [], 20 + n_table + 12 * blocks, 0
        for _, n_words, _ in heads:
            for _ in range(per):
                place.append(before + struct.unpack_from("<I", payload, at)[0])
                state.append(np.frombuffer(payload, "<u8", LANES, at + 4))
                at += 4 + 8 * LANES
            words.append(np.frombuffer(payload, "<u4", n_words, at))
            at += 4 * n_words
            before += n_words
    except (zlib.error, struct.error, ValueError) as broken:
        raise ValueError(f"broken segment: {broken}") from broken
    x = np.array(state, np.uint64)  # one row per stretch between checkpoints
    place = np.array(place, np.int64)
    stream = np.concatenate([*words, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    f64, mask, shift, word = freq.astype(np.uint64), np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    found = np.empty((CHECK, len(x), LANES), np.int32)
    last = len(stream) - 1
    for s in range(CHECK):
        low = x & mask
        sym = slot[low]
        found[s] = sym
        x = f64[sym] * (x >> shift) + low - cum[sym]
        need = x < LOW
        upto = need.cumsum(1)
        row, lane = np.nonzero(need)
        take = np.minimum(place[row] + upto[row, lane] - 1, last)
        x[row, lane] = (x[row, lane] << word) | stream[take]
        place += upto[:, -1]
    after = x.reshape(blocks, per, LANES)
    if (after[:, -1] != LOW).any() or (after[:, :-1] != np.array(state, np.uint64).reshape(after.shape)[:, 1:]).any():
        raise ValueError("a stretch does not end at the next checkpoint")
    ids = symbols[found.transpose(1, 0, 2).reshape(-1)][:n] if blocks else symbols[:0]
    for b, (k, _, crc) in enumerate(heads):
        part = ids[b * BLOCK:(b + 1) * BLOCK]
        if len(part) != k or crc32_u32(u32(part)) != crc:
            raise ValueError(f"checksum of block {b}")
    return ids


FILE = "part int, segment int, doc_ids array<long>, lengths array<int>, payload binary"


def _write_part(path: str, end: int, narrow: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        pack, kind = (ids_u16, "<u2") if narrow else (ids_u32, "<u4")
        encoder = per_worker(("words", path), lambda: WordEncoder(path, pack, b"".join))
        part = TaskContext.get().partitionId()
        docs, lengths, held, total, segment = [], [], [], 0, 0

        def row():
            ids = np.concatenate(held).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([encode(ids)], pa.binary())],
                ["part", "segment", "doc_ids", "lengths", "payload"])

        for some in text_slices(batches, "text"):
            ids, sizes = encoder.arrays(some.column(some.schema.get_field_index("text")), kind)
            # every document's ids and its end id
            stops = np.cumsum(sizes + 1)
            closed = np.full(len(ids) + len(sizes), end, ids.dtype)
            own = np.ones(len(closed), bool)
            own[stops - 1] = False
            closed[own] = ids
            names = some.column(some.schema.get_field_index("doc_id")).to_pylist()
            at = 0
            while at < len(names):  # whole documents up to the segment's size, at least one
                begin = int(stops[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(stops, begin + SEGMENT - total, "right")))
                docs += names[at:to]
                lengths += (sizes[at:to] + 1).tolist()
                held.append(closed[begin:int(stops[to - 1])])
                total, at = total + int(stops[to - 1]) - begin, to
                if total >= SEGMENT or at < len(names):
                    yield row()
                    docs, lengths, held, total, segment = [], [], [], 0, segment + 1
        if docs:
            yield row()
    return run


def write_ids(docs: DataFrame, path: str, out: str, end: int = END, text: str = "text") -> None:
    """Encode and write all documents in ascending doc_id order: one range shuffle of the rows, then narrow."""
    from tessera.llm.encoding import load
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of(text).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    narrow = load(path).get_vocab_size() <= 1 << 16
    (rows.mapInArrow(_write_part(path, end, narrow), FILE)
     .write.option("compression", "uncompressed").parquet(out))


def _read_part(with_ids: bool):
    def run(batches):
        import pyarrow as pa
        for part, segment, doc_ids, lengths, payload in row_chunks(batches, ["part", "segment", "doc_ids", "lengths", "payload"], 1):
            ids = decode(payload[0])
            ends = np.cumsum(lengths[0])
            cuts = [u32(ids[e - k:e]) for e, k in zip(ends, lengths[0])]
            n = len(cuts)
            cols = [pa.array(part * n, pa.int32()), pa.array(segment * n, pa.int32()), pa.array(doc_ids[0], pa.int64()),
                    pa.array(ends - lengths[0], pa.int64()), pa.array(lengths[0], pa.int64()), pa.array([crc32_u32(c) for c in cuts], pa.int64())]
            names = ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(cuts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids."""
    files = spark.read.schema(FILE).parquet(path)
    schema = "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = files.mapInArrow(_read_part(with_ids), schema)
    # one row per segment, summed within parts first; one row per part for the sum over all
    sizes = files.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))
    starts = (sizes.withColumn("in_part", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
              .select("part", "segment", (F.col("in_part") + F.col("parts_before")).alias("first")))
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write to the shared folder and read back."""
    out = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, out, end)
    return read_ids(docs.sparkSession, out, with_ids=False)
