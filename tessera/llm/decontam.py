"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of words (``[^\\W_]+`` of the lower-cased text).  Windows of ``MIN_MATCH`` words that an
item and a text share are the seeds: the items' window hashes are a broadcast table, a text's window hashes are made
by one running Karp-Rabin pass over its word numbers and looked up on the map side, and equal hashes are compared word by word.
Seeds that follow each other on a diagonal are one match.  Tiling then takes the longest match neither of whose sides is
marked, marks both, cuts the rest, and goes on while a match of ``MIN_MATCH`` words is left.  The share of an
item's words in tiles is its coverage; passages moved about in the text still cover it.  A text whose seeds could
not reach the threshold even if all counted is not tiled.

The items are read in blocks of about ``BLOCK_WORDS`` words, which bounds what is collected and broadcast at once whatever
the benchmark's size; each block meets all texts.

Defined results: null and empty texts and items without words match nothing; items shorter than ``MIN_MATCH`` words must
occur whole; repeated rows and items each count by themselves; ties between matches go to the earliest place in the item, then
in the text; empty tables give no rows; other columns are ignored by ``tilings`` and kept by ``with_coverage``.
"""

from __future__ import annotations

import heapq
import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, row_chunks, text_of

MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of k word numbers."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * _BASE + ids[i:i + n]
    return h


class Index:
    """Items of a block: word numbers from 1, and by window length the sorted hashes with the places that have them."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item_id, np.array(ids, np.uint64)))
        places: dict[int, list] = {}
        for i, (_, ids) in enumerate(self.items):
            k = min(min_match, len(ids))
            h = rolling(ids, k)
            places.setdefault(k, []).append((h, np.full(len(h), i), np.arange(len(h))))
        self.seeds = {}
        for k, found in places.items():
            h, item, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.seeds[k] = (keys, np.append(first, len(h)), item[order], at[order])

    def matches(self, text: str):
        """(item, k, item places, text places) of all seeds, by item."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = ids > 0
        for k, (keys, first, item, at) in self.seeds.items():
            if len(ids) < k:
                continue
            full = known[:len(ids) - k + 1].copy()
            for i in range(1, k):
                full &= known[i:len(ids) - k + 1 + i]
            where = np.flatnonzero(full)
            if not len(where):
                continue
            h = np.zeros(len(where), np.uint64)
            for i in range(k):
                h = h * _BASE + ids[where + i]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[slot] == h
            where, slot = where[hit], slot[hit]
            if not len(where):
                continue
            n = first[slot + 1] - first[slot]
            text_at = np.repeat(where, n)
            entry = np.repeat(first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            items, item_at = item[entry], at[entry]
            order = np.lexsort((item_at, text_at - item_at, items))
            items, item_at, text_at = items[order], item_at[order], text_at[order]
            cuts = np.flatnonzero(np.diff(items)) + 1
            for i, p, t in zip(np.split(items, cuts), np.split(item_at, cuts), np.split(text_at, cuts)):
                own = self.items[i[0]][1]
                same = np.ones(len(p), bool)
                for j in range(k):
                    same &= own[p + j] == ids[t + j]
                if same.any():
                    yield int(i[0]), k, p[same], t[same]

    def tilings(self, text: str, threshold: float = THRESHOLD):
        """(item_id, item words, tiles) of every item covered to the threshold; a tile is (item place, text place, words)."""
        for i, k, p, t in self.matches(text):
            item_id, own = self.items[i]
            reach = np.zeros(len(own) + 1, np.int64)
            np.add.at(reach, p, 1)
            np.add.at(reach, p + k, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(own):
                continue
            tiles = tile(p, t, k, len(own))
            if sum(n for _, _, n in tiles) >= threshold * len(own):
                yield item_id, len(own), tiles


def tile(p: np.ndarray, t: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the matches made of seeds (p, t), sorted by diagonal and place."""
    start = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(t) != 1)]))
    length = np.diff(np.append(start, len(p))) + k - 1
    heap = [(-int(n), int(p[s]), int(t[s])) for s, n in zip(start, length)]
    heapq.heapify(heap)
    in_item, in_text, tiles, left = bytearray(n_item), set(), [], n_item
    while heap and left >= k:
        n, a, b = heapq.heappop(heap)
        n = -n
        free, pieces = 0, []
        for i in range(n + 1):
            if i < n and not in_item[a + i] and b + i not in in_text:
                free += 1
            else:
                if free:
                    pieces.append((i - free, free))
                free = 0
        if pieces and pieces[0][1] == n:
            tiles.append((a, b, n))
            in_item[a:a + n] = b"\1" * n
            in_text.update(range(b, b + n))
            left -= n
        else:
            for i, m in pieces:
                if m >= k:
                    heapq.heappush(heap, (-m, a + i, b + i))
    return tiles


def item_blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_WORDS words, collected one at a time."""
    rows = benchmark.select("item_id", text_of("text").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * BLOCK_WORDS)))
    if blocks == 1:
        yield [tuple(r) for r in rows.collect()]
        return
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


TILING = ("doc_id long, item_id long, n_tiles int, longest_tile int, matched_words int, item_words int, coverage double, "
          "tiles array<struct<item_start:int,text_start:int,words:int>>")


def _tile_batches(shared, key, min_match, threshold):
    def run(batches):
        import pyarrow as pa
        index = per_worker(("index", key), lambda: Index(shared.value, min_match), keep=8)
        names = ["doc_id", "item_id", "n_tiles", "longest_tile", "matched_words", "item_words", "coverage", "tiles"]
        spot = pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("words", pa.int32())])
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.list_(spot)]
        for docs, texts in row_chunks(batches, ["doc_id", "text"]):
            rows = []
            for doc, text in zip(docs, texts):
                for item, n, tiles in index.tilings(text, threshold):
                    got = sum(x for _, _, x in tiles)
                    rows.append((doc, item, len(tiles), max(x for _, _, x in tiles), got, n, got / n,
                                 [{"item_start": a, "text_start": b, "words": x} for a, b, x in tiles]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
    return run


def tilings(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item covered to the threshold, with its tiles; no shuffle."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_tile_batches(shared, uuid.uuid4().hex, min_match, threshold), TILING)
        out = found if out is None else out.unionByName(found)
    return out


def with_coverage(docs: DataFrame, benchmark: DataFrame, out: str = "coverage", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """Adds each row's largest coverage of an item if that reaches the threshold, else 0."""
    best = F.lit(0.0)
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        best = F.greatest(best, _covered(shared, uuid.uuid4().hex, min_match, threshold)(text_of("text")))
    return docs.withColumn(out, best)


def _covered(shared, key, min_match, threshold):
    @F.pandas_udf("double")
    def covered(texts):
        import pandas as pd
        index = per_worker(("index", key), lambda: Index(shared.value, min_match), keep=8)
        return pd.Series([max((sum(x for _, _, x in tiles) / n for _, n, tiles in index.tilings(t, threshold)), default=0.0) for t in texts],
                         dtype="float64")

    return covered
