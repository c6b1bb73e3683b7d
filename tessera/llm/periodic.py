"""Runs (maximal periodic stretches of words) found on a harmonic grid with a difference-cover LCE.

A run of period p and at least 4p words holds four neighbouring points of the grid 0, p, 2p, ..., and neighbouring points hold
equal words.  So for each p the grid's words are compared with their neighbours (n / p comparisons, n ln n in all); a
stretch of three equal neighbours is a candidate, and the longest common extension of its first two points, forward and
backward, gives the run.  Equal stretches of several periods belong to the least.

``Lce`` answers longest common extensions.  Of all suffixes only those at places i with i mod V in the difference cover are
sorted (names of V-word blocks, doubled until all differ), with the common prefixes of neighbours in a sparse table.
For any two places some shift below V brings both to sampled places: so many words are compared, then one range minimum
tells the rest.  Texts of a slice are laid out one after the other, longest first, each closed by a word of its own, and
only texts with a candidate are sorted.

Defined results: null and empty texts have no words and no runs (nulls, digests of the empty string); words are compared byte by
byte; a text of any length is treated whole in one task, in memory linear in its words (times log for the sampled sixth);
repeated rows each get their own row; ties of the strongest run go to the least start, then the least period; an
empty table gives an empty result; other columns are returned as they are, but columns named as the result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import text_of, text_slices

#: A perfect difference set: every residue mod V is a difference of two of its numbers.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
LEAST_WORDS, LEAST_EXPONENT = 6, 4
BLANKS = r"[\x20\x09-\x0D]+"


def _shifts() -> np.ndarray:
    """For residues a, b the least shift that brings both into the cover."""
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True
    s = np.arange(V)
    both = inside[(s[:, None, None] + s[None, :, None]) % V] & inside[(s[:, None, None] + s[None, None, :]) % V]
    return both.argmax(axis=0)


class Lce:
    """Longest common extensions of places in ``words`` (numbers; some word must end every repetition, as closing words do)."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        pad = words.max(initial=0) + 1
        self.words = np.concatenate([words, np.arange(pad, pad + V)])  # past the end nothing is equal
        at = np.arange(n)
        inside = np.zeros(V, bool)
        inside[list(COVER)] = True
        self.places = at[inside[at % V]]
        self.rank = np.full(n + 1, -1, np.int64)
        blocks = self.words[self.places[:, None] + np.arange(V)].astype(">u4")
        rows = np.ascontiguousarray(blocks).view(f"V{4 * V}").ravel()
        names = np.unique(rows, return_inverse=True)[1].astype(np.int64).ravel()
        index = np.full(n + 1, -1, np.int64)  # place -> number of the sampled place
        index[self.places] = np.arange(len(self.places))
        levels, step = [names], V
        while len(names) and names.max() + 1 < len(names):
            later = index[np.minimum(self.places + step, n)]
            after = np.where(later >= 0, names[later], -1)
            names = np.unique(names * (len(names) + 1) + after + 1, return_inverse=True)[1].astype(np.int64).ravel()
            levels.append(names)
            step *= 2
        order = np.argsort(names)
        self.rank[self.places] = names
        self.table = [self._neighbours(levels, index, order)]
        width = 1
        while 2 * width <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, levels: list, index: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes that are neighbours in order: blocks from long to short, then words."""
        a, b = self.places[order[:-1]], self.places[order[1:]]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = index[np.minimum(a + length, self.n)], index[np.minimum(b + length, self.n)]
            same = (x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y])
            length += same * (V << k)
        return length + self._direct(a + length, b + length, np.full(len(a), V))

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most ``most`` (below or equal V)."""
        out, last = np.zeros(len(a), np.int64), len(self.words) - 1
        left = np.arange(len(a))
        for s in range(V):
            left = left[most[left] > s]
            left = left[self.words[np.minimum(a[left] + s, last)] == self.words[np.minimum(b[left] + s, last)]]
            if not len(left):
                break
            out[left] += 1
        return out

    SHIFT = _shifts()

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of each pair of places a < b."""
        shift = self.SHIFT[a % V, b % V]
        out = self._direct(a, b, shift)
        on = np.flatnonzero((out == shift) & (b + shift < self.n))
        x, y = self.rank[a[on] + shift[on]], self.rank[b[on] + shift[on]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            t = self.table[k]
            out[on[i]] += np.minimum(t[low[i]], t[high[i] - (1 << int(k))])
        return out


def grid_candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(period, first place) of every three equal neighbours on a grid; texts must come longest first."""
    periods, places = [], []
    longest = int(sizes[0]) if len(sizes) else 0
    for p in range(1, longest // LEAST_EXPONENT + 1):
        fit = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_EXPONENT * p), "right"))
        if not fit:
            break
        grid = words[:starts[fit - 1] + sizes[fit - 1]:p]
        same = grid[1:] == grid[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) if len(same) > 2 else ()
        if len(k):
            periods.append(np.full(len(k), p, np.int64))
            places.append(k.astype(np.int64) * p)
    none = np.zeros(0, np.int64)
    return (np.concatenate(periods), np.concatenate(places)) if periods else (none, none)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text, given as word numbers, its runs as rows (start, length, period), sorted by start, then period."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= LEAST_WORDS]
    laid, starts = _lay_out([texts[i] for i in order])
    period, place = grid_candidates(laid, starts, size[order])
    if not len(period):
        return out
    owner = np.searchsorted(starts, place, "right") - 1
    with_runs = np.unique(owner)  # only these texts are sorted
    sub, sub_starts = _lay_out([texts[order[i]] for i in with_runs])
    moved = np.searchsorted(with_runs, owner)
    place = place - starts[owner] + sub_starts[moved]
    found = _extend(sub, period, place)
    own = np.searchsorted(sub_starts, found[:, 0], "right") - 1
    found[:, 0] -= sub_starts[own]
    for i in np.unique(own):
        out[order[with_runs[i]]] = found[own == i]
    return out


def _lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each closed by a word no other place has; and where they start."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = max(int(t.max(initial=-1)) for t in texts) + 1
    laid = np.concatenate([x for i, t in enumerate(texts) for x in (t, [top + i])]).astype(np.int64)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return laid, np.cumsum(size) - size


def _extend(words: np.ndarray, period: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Runs (start, length, least period) that hold a candidate, sorted.  Of a block of neighbouring candidates the first is
    extended, those within its run are done with, and so on."""
    ahead, back, n = Lce(words), Lce(words[::-1]), len(words)
    least: dict = {}
    k = place // period
    block = np.cumsum(np.concatenate([[True], (np.diff(period) != 0) | (np.diff(k) != 1)])) - 1
    while len(place):
        first = np.concatenate([[True], np.diff(block) != 0])
        i, p = place[first], period[first]
        reach = i + ahead.query(i, i + p)                       # words i .. reach + p - 1 keep the period
        start = i - back.query(n - 1 - (i + p - 1), n - 1 - (i - 1)) if len(i) else i
        length = reach + p - start
        for s, m, q in zip(start.tolist(), length.tolist(), p.tolist()):
            if m >= max(LEAST_WORDS, LEAST_EXPONENT * q):
                least[s, m] = min(q, least.get((s, m), q))
        stay = ~first & (place >= reach[np.cumsum(first) - 1])
        place, period, block = place[stay], period[stay], block[stay]
    return np.array(sorted((s, m, q) for (s, m), q in least.items()), np.int64).reshape(-1, 3)


def strongest(runs: np.ndarray) -> tuple | None:
    """Run of the greatest exact length / period; ties go to the least start, then period."""
    if not len(runs):
        return None
    scale = int(runs[:, 2].max()) ** 2  # two unequal fractions differ by 1 / scale or more
    s, m, q = min(((s, m, q) for s, m, q in runs.tolist()), key=lambda r: (-(r[1] * scale // r[2]), r[0], r[2]))
    return s, m, q, 1000 * m // q


def _rows(batch, text: str):
    """Runs, strongest run and collapsed text of each text of an Arrow batch."""
    import pyarrow as pa
    import pyarrow.compute as pc
    split = pc.ascii_split_whitespace(batch.column(batch.schema.get_field_index(text)))
    flat = split.flatten()
    keep = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(keep)])[edges]
    flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    texts = [numbers[a:b] for a, b in zip(edges[:-1], edges[1:])]
    all_runs = find_runs(texts)
    change = np.zeros(len(numbers) + 1, np.int64)
    for a, runs in zip(edges, all_runs):
        np.add.at(change, a + runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, a + runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(stays)])[edges]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(stays))), " ")
    return all_runs, collapsed


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds runs (array of start, length, period), best (the strongest run with exponent_milli, or null) and collapsed (the text
    without what its runs repeat)."""
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    best = StructType([*run.fields, StructField("exponent_milli", LongType())])
    docs = docs.drop("runs", "best", "collapsed").withColumn("__words", text_of(text))
    own = [c for c in docs.columns if c != "__words"]
    schema = StructType([*(docs.schema[c] for c in own), StructField("runs", ArrayType(run)), StructField("best", best),
                         StructField("collapsed", StringType())])

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for part in text_slices(batches, "__words", 4 << 20):
            all_runs, collapsed = _rows(part, "__words")
            table = np.concatenate([np.zeros((0, 3), np.int64), *all_runs])
            ends = np.cumsum([0] + [len(r) for r in all_runs])
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, c])) for c in range(3)], fields=list(kinds))
            top = [strongest(r) for r in all_runs]
            top = [t and dict(zip(("start", "length", "period", "exponent_milli"), t)) for t in top]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in own), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                 pa.array(top, pa.struct([*kinds, ("exponent_milli", pa.int64())])), collapsed],
                [*own, "runs", "best", "collapsed"])

    return docs.mapInArrow(found, schema)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = with_runs(docs.select("doc_id", F.col(text).alias("text")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period", "exponent_milli")),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_periods(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts in which a tenth of the documents, chosen by crc32 of doc_id, go on periodically from some word; others, and those of a
    null doc_id, stay as they are."""
    words = F.filter(F.split(text_of(text), BLANKS), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.withColumns({"__w": words, "__g": F.floor(h / 10), "__hit": F.coalesce(h % 10 == 0, F.lit(False))})
    d = d.withColumn("__n", F.size("__w")).withColumn("__a", F.expr("cast(if(__n > 0, __g % __n, 0) as int)"))
    d = d.withColumn("__p", F.expr("cast(1 + floor((__n - __a) / (3 + __g % 8)) as int)"))
    again = F.expr("slice(flatten(array_repeat(slice(__w, __a + 1, __p), cast(ceil((__n - __a) / __p) as int))), 1, __n - __a)")
    whole = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), again), " ")
    return d.withColumn(text, F.when(F.col("__hit") & (F.col("__n") > 0), whole).otherwise(F.col(text))).drop("__w", "__g", "__hit", "__n", "__a", "__p")
