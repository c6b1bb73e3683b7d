"""Near duplicates by Order MinHash.

A text is its words (``[^\\W_]+`` of the lower-cased text); its k-mers are windows of five words, labelled by their occurrence
(first, second, ... time in the text), so no two of a text are equal.  Each of ``SKETCHES`` sketches takes the ``PICK`` labelled k-mers
least under its own hash and keeps them in the order of the text: two texts agree in a sketch if the same k-mers come in the
same order, which follows edit similarity and not only overlap.  A text that repeats k-mers is sketched twice, by all of them and by
first occurrences alone, and steps 2 and 3 hold for either kind.

1. Texts of equal word sequences are one node (exact copies are never compared).
2. Nodes that agree in a sketch share a bucket.  A bucket of up to ``SMALL`` nodes gives all its pairs.  A larger one gives a
   star: each node with the bucket's most connected one; and it is split by the next sketch's value and looked at again, down to
   nodes that agree in all sketches.  So every node meets centres and its closest fellows, and these pairs grow linearly with the nodes.
3. Candidates are left out if their lengths differ by more than a fifth, which no similarity below allows, or if they share less
   than ``SIEVE`` of the picked k-mers: one sketch and two more k-mers pass.  At word edit similarity 0.8 with changes spread evenly,
   a k-mer in three stays whole and a candidate shares fewer with a chance below 0.01.
4. The rest are verified by banded alignment of their words: similarity is 1 - (words to change, insert or delete) / (words of the
   longer text).  A pair of 0.8 or more stays within a band of 0.2 times the longer text; narrower bands are tried first and are
   exact whenever the distance they give fits into them.  Pairs below are also aligned by labelled k-mers (the longest
   chain of common ones that rises in both; similarity chain / (all k-mers of both - chain)), of all and of first occurrences alone,
   so how often a text repeats a line does not part it from its copies.  The largest value counts.
5. Verified pairs are links; classes are connected components: nodes hook onto their least neighbours, pointer jumping finds the roots,
   and only links between different roots go on to the next round.
6. Nodes of a large bucket that are of different components are then compared too, so no pair that shares a bucket is left out by its
   size.  They meet in blocks of bounded size, where common words and common distinct k-mers are counted; pairs that hold
   enough of either for the threshold are aligned, most alike first, unless links found before join them already.

Every table that a later step joins is written first, so joins are between plain scans that AQE may split at hot keys; it is deleted
when the steps that read it are done (but for the two that the lazy result itself reads).

Defined results: each row gets one class; class_id is the least doc_id of the class (null only if all are null) and exactly one row
of a class is kept (least doc_id, nulls last); null and empty texts are one class; texts without words are alike only if equal;
texts of fewer than five words are alike only if their words are; repeated rows are copies; an empty table gives an empty one; very
long texts are aligned whole (bit vectors as wide as the band, memory in proportion to the text); extra columns of any name ride along.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from functools import cached_property
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BoundedCache, discard, per_worker, row_chunks, text_of, written
from tessera.sources.tables import with_file_order

K = 5
THRESHOLD = 0.8
SKETCHES = 16
PICK = 2
SMALL = 16
PART = 2048
PART_WORDS = 1 << 19
SIEVE = 0.125

_WORD = re.compile(r"[^\W_]+")
_BLANKED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words_of(text: str) -> list[str]:
    """``[^\\W_]+`` of the lower-cased text: all other characters are made blanks."""
    text = text.lower()
    if not text.isascii():
        odd = [c for c in set(text) if c > "\x7f" and not c.isalnum()]
        if len(odd) > 50 or any("\ud800" <= c <= "\udfff" for c in odd):
            return _WORD.findall(text)
        for c in odd:
            text = text.replace(c, " ")
    return text.encode().translate(_BLANKED).decode().split()


_SHIFTS = [np.uint64(x) for x in (30, 27, 31)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _SHIFTS[0])
    x *= _ODD[1]
    x ^= x >> _SHIFTS[1]
    x *= _ODD[2]
    x ^= x >> _SHIFTS[2]
    return x


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD[0])


class Hasher:
    """Labelled k-mer hashes of texts; word hashes come from a bounded cache."""

    def __init__(self):
        self.words = BoundedCache(lambda w: xxhash.xxh64_intdigest(w))

    def kmers(self, words: list[str]) -> np.ndarray:
        """Hashes of the labelled k-mers in the order of the text; a shorter text is one k-mer."""
        return self.labelled(words)[0]

    def labelled(self, words: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, and which k-mers are first occurrences."""
        n = len(words)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, bool)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        k = min(k, n)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * _ODD[0] + w[i:i + n - k + 1])
        first = np.ones(len(h), bool)
        ranked = np.sort(h)
        if (ranked[1:] == ranked[:-1]).any():
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            first[order[~new]] = False
            at = np.arange(len(h))
            occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
            again = occurrence > 0
            h[order[again]] = _mix(ranked[again] + occurrence[again].astype(np.uint64) * _ODD[0])
        return h, first


def sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch values (signed 64-bit) and the picked hashes, sketch by sketch (32 bits of them)."""
    picked = np.empty((SKETCHES, min(PICK, len(h))), np.uint64)
    step = max(1, (1 << 18) // max(1, len(h)))  # sketches at a time, so that long texts take little memory
    for j in range(0, SKETCHES, step):
        x = _mix(h ^ _SEEDS[j:j + step, None])
        if len(h) > PICK:
            at = np.empty((len(x), PICK), np.int64)
            least = np.empty((len(x), PICK), np.uint64)
            row = np.arange(len(x))
            for p in range(PICK):
                at[:, p] = x.argmin(axis=1)
                least[:, p] = x[row, at[:, p]]
                x[row, at[:, p]] = ~np.uint64(0)
            picked[j:j + step] = np.take_along_axis(least, at.argsort(axis=1), axis=1)  # in the order of the text
        else:
            picked[j:j + step] = x
    keys = _SEEDS
    for p in range(picked.shape[1]):
        keys = _mix(keys ^ picked[:, p])
    return keys.astype(np.int64), picked.astype(np.uint32).astype(np.int32).ravel()


class _Masks:
    """Bit masks of where each word stands in rows ``start`` to ``start + size`` of a text, made when asked for.  Few are held at a
    time, so a long text of many words takes little memory."""

    def __init__(self, words: list[str]):
        self.places = defaultdict(list)
        for i, w in enumerate(words):
            self.places[w].append(i)

    def frame(self, start: int, size: int) -> None:
        self.start, self.size, self.held = start, size, {}
        self.most = max(64, (1 << 29) // max(1, size))

    def __getitem__(self, word: str) -> int:
        mask = self.held.get(word)
        if mask is None:
            at = self.places.get(word, ())
            lo, hi = bisect.bisect_left(at, self.start), bisect.bisect_left(at, self.start + self.size)
            if hi - lo < 4:
                mask = sum(1 << (i - self.start) for i in at[lo:hi])
            else:
                bits = np.zeros(self.size, np.uint8)
                bits[np.array(at[lo:hi]) - self.start] = 1
                mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[word] = mask
        return mask


def _in_band(masks: _Masks, m: int, b: list[str], band: int, limit: int) -> int:
    """Edit distance of a text of ``m`` words, given by its masks, to ``b`` along paths that stay ``band`` off the diagonal at most;
    stops above ``limit``.  A column of the table is two bit vectors, of rows one higher and of rows one lower than the row
    before, over the rows j - band to j + band of column j; the value is followed along the last cell's own diagonal."""
    n, width = len(b), 2 * band + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << band) - 1), 0
    diagonal = 1 << (m - n + band)
    distance = max(m - n, 0)
    tile = max(1024, 2 * width)
    for first in range(1, n + 1, tile):
        start = max(0, first - band - 1)
        masks.frame(start, tile + width)
        held = masks.held
        for j in range(first, min(n, first + tile - 1) + 1):
            shift = j - band - 1 - start
            mask = held.get(b[j - 1])
            if mask is None:
                mask = masks[b[j - 1]]
            same = (mask >> shift if shift >= 0 else mask << -shift) & full
            level = ((((same & up) + up) ^ up) | same | down) & full  # cells equal to their upper left neighbour
            if not level & diagonal:
                distance += 1
                if distance > limit:
                    return distance
            higher, lower = down | (full ^ (level | up)), level & up
            level >>= 1
            up = lower | (full ^ (level | higher))
            down = level & higher
    return distance


def edit_distance(a: list[str], b: list[str], limit: int, least: int = 0) -> int:
    """Words to change, insert or delete; some number above ``limit`` if they are more.  They are known to be ``least`` or more,
    so no narrower band is tried."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    tail = 0
    for x, y in zip(reversed(a[head:]), reversed(b[head:])):
        if x != y:
            break
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    masks = _Masks(a)
    band = min(limit, max(abs(len(a) - len(b)), least, 29))
    while True:
        distance = _in_band(masks, len(a), b, band, limit)
        if distance <= band or band >= limit:
            return distance
        band = min(limit, 4 * band)


def word_similarity(a: list[str], b: list[str], threshold: float = THRESHOLD) -> float:
    """1 - edit distance / longer length, by banded alignment; exact for pairs of at least ``threshold``, else 0."""
    longer = max(len(a), len(b))
    limit = int((1 - threshold) * longer + 1e-9)
    least = longer - (Counter(a) & Counter(b)).total()  # no alignment matches more words
    if least > limit:
        return 0.0
    distance = edit_distance(a, b, limit, least)
    return 1 - distance / longer if distance <= limit else 0.0


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Banded alignment of labelled k-mers; exact for pairs of at least ``threshold``, else a lower bound."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    if len(common) < threshold * (total - len(common)):
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= (1 - threshold) * max(len(a), len(b)) + 1e-9]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            tails[at:at + 1] = [x]
        chain = len(tails)
    return chain / (total - chain)


# ---- candidates -----------------------------------------------------------------------------------------------------


class _Sketch(NamedTuple):
    kind: int  # 0: all labelled k-mers, 1: first occurrences alone, of texts that have others
    n: int
    keys: np.ndarray
    picked: np.ndarray


SKETCHED = "array<struct<kind:int,n:int,keys:array<long>,picked:array<int>>>"


def _sketch_arrays(sketches: list[list[_Sketch]]):
    """The column of each text's sketches, from flat arrays."""
    import pyarrow as pa
    flat = [x for one in sketches for x in one]

    def lists(parts, kind):
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind)))

    items = pa.StructArray.from_arrays(
        [pa.array([x.kind for x in flat], pa.int32()), pa.array([x.n for x in flat], pa.int32()),
         lists([x.keys for x in flat], np.int64), lists([x.picked for x in flat], np.int32)], ["kind", "n", "keys", "picked"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)], dtype=np.int32)), items)


def _sketch_batches(names):
    def run(batches):
        import pyarrow as pa
        hasher = per_worker("hasher", Hasher)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                groups, sketches = [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words = words_of(text)
                    groups.append(xxhash.xxh128_digest("w " + " ".join(words) if words else "t " + text.strip()))
                    h, first = hasher.labelled(words)
                    one = [_Sketch(0, len(h), *sketch(h))] if len(words) >= K else []
                    if one and not first.all():
                        one.append(_Sketch(1, int(first.sum()), *sketch(h[first])))
                    sketches.append(one)
                rest = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(groups, pa.binary()), _sketch_arrays(sketches)], [*names, "grp", "sketches"])
    return run


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes that small buckets, stars and parts of large ones bring together, and (key, node, n) of the large.

    Both kinds of sketches share the buckets: those of a text without repetition serve as either."""
    sketches = nodes.select("node", F.explode("sketches").alias("s")).select("node", "s.kind", "s.n", "s.keys")
    entries = sketches.select("node", "kind", "n", F.posexplode("keys").alias("band", "key"))
    sketches = sketches.drop("n")
    pairs, level, degree, done = None, 0, None, []
    while True:
        counts = written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
        held = written(entries.join(counts.hint("merge"), "key"), "bucket-entries")
        if degree is None:
            degree = written(held.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
            members = written(held.where(F.col("size") > SMALL).groupBy("key", "node").agg(F.max("n").alias("n")), "large-members")
        small, large = held.where(F.col("size") <= SMALL), held.where(F.col("size") > SMALL)
        together = small.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("all"))  # SMALL at most
        found = together.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(
            F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
        level += 1
        last = large.isEmpty()
        if not last:
            if level == 1:  # later entries carry these along
                large = written(large.drop("n").join(degree, "node").join(sketches, ["node", "kind"]), "large-buckets")
            centres = written(large.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("c"))
                              .select("key", (-F.col("c.minus")).alias("centre")), "centres")
            star = (large.join(centres, "key").where("centre <> node")
                    .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")))
            found = found.unionByName(star)
        found = written(found.distinct(), "pairs")
        done += [found, counts, held] + ([] if last else [centres]) + ([large] if level == 1 and not last else [])
        pairs = found if pairs is None else pairs.unionByName(found)
        if last or level == SKETCHES:
            pairs = written(pairs.distinct(), "candidates")
            for t in [*done, degree]:
                discard(t)
            return pairs, members
        # a large bucket is parted by the value of the next sketch
        nxt = F.element_at("keys", (F.pmod(F.col("band") + level, F.lit(SKETCHES)) + 1).cast("int"))
        entries = large.select("node", "kind", "band", "degree", "keys", F.xxhash64("key", nxt).alias("key"))


class Prepared:
    """Words and, if asked for, labelled k-mers of a text."""

    def __init__(self, words: list[str], hasher: Hasher):
        self.words, self.hasher = words, hasher

    @cached_property
    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hasher.labelled(self.words)


def pair_similarity(a: Prepared, b: Prepared) -> float:
    """The alignment of words; below the threshold that of all labelled k-mers or of first occurrences alone, if larger: a passage
    that one text repeats more often than the other does not part them."""
    s = word_similarity(a.words, b.words)
    if s >= THRESHOLD:
        return s
    (ha, fa), (hb, fb) = a.labelled, b.labelled
    s = max(s, similarity(ha, hb))
    if s >= THRESHOLD or (fa.all() and fb.all()):
        return s
    return max(s, similarity(ha[fa], hb[fb]))


def _verify(batches):
    import pyarrow as pa
    hasher = per_worker("hasher", Hasher)
    memo: dict[int, Prepared] = {}

    def prepared(node, text):
        if node not in memo:
            if len(memo) > 64:
                memo.clear()
            memo[node] = Prepared(words_of(text), hasher)
        return memo[node]

    for a, b, ta, tb in row_chunks(batches, ["a", "b", "text_a", "text_b"], 64):
        s = [pair_similarity(prepared(x, p), prepared(y, q)) for x, y, p, q in zip(a, b, ta, tb)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def _counted(features: list[np.ndarray], left: np.ndarray, right: np.ndarray, enough):
    """(x, some of ``right``, how many features they share) for each x of ``left``, where ``enough(n_x, n_y, shared)`` holds.  A text's
    features are distinct; texts that differ in their number by more than the threshold allows are left out."""
    n = np.array([len(f) for f in features])
    ids = np.unique(np.concatenate(features), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(n)[:-1])
    right = right[np.argsort(n[right], kind="stable")]
    right = right[n[right] > 0]
    if not len(right):
        return
    held = np.concatenate([ids[y] for y in right])
    ends = np.concatenate([[0], np.cumsum(n[right])])
    mark = np.zeros(sum(map(len, features)), np.uint8)
    for x in left[n[left] > 0]:
        lo, hi = np.searchsorted(n[right], [THRESHOLD * n[x] - 1e-6, n[x] / THRESHOLD + 1e-6])
        if lo < hi:
            mark[ids[x]] = 1
            shared = np.add.reduceat(mark[held[ends[lo]:ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
            mark[ids[x]] = 0
            at = enough(n[x], n[right[lo:hi]], shared)
            yield x, right[lo:hi][at], shared[at]


def _block(table):
    """Links between the left and the right nodes of a block that, with the labels, join all its similar pairs.  A pair of several
    common buckets is left to the least of them."""
    import pyarrow as pa
    hasher = per_worker("hasher", Hasher)
    node, label, stray = (table.column(c).to_numpy() for c in ("node", "label", "stray"))
    left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
    key, keys = table.column("key")[0].as_py(), [set(x) for x in table.column("keys").to_pylist()]
    texts = [Prepared(words_of(t.as_py()), hasher) for t in table.column("text")]
    labelled_words = [hasher.labelled(t.words, 1)[0] for t in texts]
    kmers = [h[first] for h, first in (hasher.labelled(t.words) for t in texts)]
    as_words = lambda n, m, shared: shared >= THRESHOLD * np.maximum(n, m) - 1e-6  # noqa: E731  alignments of words and of all labelled k-mers
    as_kmers = lambda n, m, shared: shared >= THRESHOLD * (n + m - shared) - 1e-6  # noqa: E731  that of first occurrences
    found = [np.empty((3, 0))]
    for features, enough in ((labelled_words, as_words), (kmers, as_kmers)):
        for x, ys, shared in _counted(features, left, right, enough):
            at = (label[ys] != label[x]) & (~stray[ys] | (node[x] < node[ys]))
            if at.any():
                found.append(np.stack([np.full(at.sum(), x), ys[at], shared[at] / len(features[x])]))
    found = np.concatenate(found, axis=1)
    of = {x: x for x in label.tolist()}

    def root(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    links, seen = [], set()
    for x, y in found[:2, np.argsort(-found[2], kind="stable")].T.astype(int).tolist():
        one, other = root(label[x].item()), root(label[y].item())
        if one != other and (x, y) not in seen and min(keys[x] & keys[y]) == key:
            seen.add((x, y))
            s = pair_similarity(texts[x], texts[y])
            if s >= THRESHOLD:
                of[one] = other
                links.append((*sorted((node[x].item(), node[y].item())), s))
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*links) if links else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))],
                    ["a", "b", "similarity"])


def _unmet(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links (a, b, similarity) that join all similar pairs of nodes of different components that share a large bucket; None if no bucket
    has nodes of several.

    Each such pair has a node outside the bucket's largest component, a stray.  Strays and all nodes of a bucket are dealt into parts of
    bounded size, and each part of strays meets each part of nodes in a block of its own."""
    placed = written(members.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "large-labelled")
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    mixed = sizes.groupBy("key").agg(
        F.count("*").alias("labels"), F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.max(F.struct("rows", "label", "words")).alias("most"))
    parts = lambda rows, words: F.greatest(F.ceil(rows / PART), F.ceil(words / PART_WORDS)).cast("int")
    mixed = mixed.where("labels > 1").select(
        "key", F.col("most.label").alias("largest"), parts(F.col("rows"), F.col("words")).alias("parts"),
        parts(F.col("rows") - F.col("most.rows"), F.col("words") - F.col("most.words")).alias("stray_parts"))
    mixed = written(placed.join(mixed.hint("merge"), "key").withColumn("stray", F.col("label") != F.col("largest")), "large-mixed")
    discard(placed)
    if mixed.isEmpty():
        discard(mixed)
        return None
    bucket = F.struct("key", "stray", "parts", "stray_parts")
    by_node = mixed.groupBy("node", "label").agg(F.collect_list(bucket).alias("buckets")).join(texts.hint("merge"), "node")
    held = by_node.select("node", "label", "text", F.col("buckets.key").alias("keys"), F.explode("buckets").alias("b")).select("*", "b.*").drop("b")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    met = F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("stray_parts") - 1), lambda i: F.struct(i.alias("i"), part("parts").alias("j"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.col("stray")),
                    lambda j: F.struct(part("stray_parts").alias("i"), j.alias("j"))))
    blocks = held.withColumn("at", F.explode(met)).select(
        "key", "at.i", "at.j", "node", "label", "stray", "keys", "text", (F.col("stray") & (F.col("at.i") == part("stray_parts"))).alias("left"),
        (F.col("at.j") == part("parts")).alias("right"))
    links = written(blocks.groupBy("key", "i", "j").applyInArrow(_block, "a long, b long, similarity double"), "block-links")
    discard(mixed)
    return links


def _sieved(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs near in length that share enough of the picked k-mers.

    Joins are sort-merge at every size: pairs and texts grow with the input, so no side is to be broadcast."""
    # lengths as words, and how many of their distinct picked k-mers both share; very short texts are left to the alignment
    short = lambda s: F.struct(s["n"].alias("n"), F.array_distinct(s["picked"]).alias("picked"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.transform("sketches", short).alias(f"s_{x}")).hint("merge")

    def alike(a, b):
        near = F.least(a["n"], b["n"]) + (K - 1) >= THRESHOLD * (F.greatest(a["n"], b["n"]) + (K - 1)) - 1e-6
        return near & ((F.least(a["n"], b["n"]) < 40) | (
            F.size(F.array_intersect(a["picked"], b["picked"])) >= SIEVE * F.least(F.size(a["picked"]), F.size(b["picked"]))))

    of = lambda x, at: F.element_at(f"s_{x}", at)  # noqa: E731  (1: all k-mers, -1: first occurrences, the same without repetition)
    sieved = (pairs.join(side("a"), "a").join(side("b"), "b")
              .where(alike(of("a", 1), of("b", 1)) | alike(of("a", -1), of("b", -1))).select("a", "b"))
    return written(sieved, "sieved")


def _verified(sieved: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar."""
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    checked = sieved.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verify, "a long, b long, similarity double")
    return written(checked.where(F.col("similarity") >= THRESHOLD), "links")


def linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes, label the least node of the class.  ``nodes``: node, sketches; ``texts``: node, text of
    these and more."""
    pairs, members = _candidates(nodes)
    sieved = _sieved(pairs, nodes)
    needed = sieved.select(F.col("a").alias("node")).unionByName(sieved.select(F.col("b").alias("node"))).unionByName(members.select("node"))
    texts = written(texts.join(needed.distinct().hint("merge"), "node"), "texts", compression="zstd")
    found = _verified(sieved, texts)
    labels = components(found)
    done = [pairs, members, sieved, texts, found]
    more = _unmet(members, labels, texts)
    if more is not None:
        done.append(more)
        if not more.isEmpty():
            forest = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))  # for the links found before
            done.append(labels)
            labels = components(forest.unionByName(more.select("a", "b")))
    for t in done:
        discard(t)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes, label the least node of the component.

    In each round a node hooks onto its least neighbour, if that is less, and pointer jumping leads it to the root.  Edges are then taken
    between roots, each once, and those within a tree go; so no later round reads the links of a dense group again.  A node that none
    hooked onto has lesser neighbours alone by the next round, so two rounds halve the nodes at least."""
    total = lambda t: t.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    edges, labels = written(edges.select("a", "b"), "edges"), None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "roots")
        before, after = None, total(roots)
        while after != before:
            jump = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = written(roots.join(jump, "label").select("node", F.col("further").alias("label")), "roots")
            discard(roots)
            roots, before, after = new, after, total(new)
        root = lambda x: roots.select(F.col("node").alias(x), F.col("label").alias(f"root_{x}"))
        between = edges.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
        between = written(between.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = between
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new = written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
            for t in (labels, roots):
                discard(t)
            labels = new
    discard(edges)
    return labels


ROW = "__llm_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row that is the same at every read; rows of no file are written first."""
    try:
        return with_file_order(docs, ROW)
    except AnalysisException as no_file:
        if "_metadata" not in str(no_file):
            raise
        return with_file_order(written(docs, "documents"), ROW)


def _classes(placed: DataFrame) -> DataFrame:
    """doc_id, row, class_id and kept of numbered rows."""
    rows = placed.select("doc_id", F.col(ROW).alias("row"), text_of("text").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, row long, grp binary, sketches {SKETCHED}"
    sketched = written(rows.mapInArrow(_sketch_batches(["doc_id", "row"]), schema), "sketched")
    groups = written(sketched.groupBy("grp").agg(F.min("row").alias("node")), "groups")
    full = written(sketched.join(groups.hint("merge"), "grp").drop("grp"), "grouped")
    members = full.select("doc_id", "row", "node")
    for t in (sketched, groups):
        discard(t)
    nodes = full.where((F.col("row") == F.col("node")) & (F.size("sketches") > 0)).select("node", "sketches")
    labels = linked(nodes, rows.select(F.col("row").alias("node"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = members.groupBy("node").agg(F.min(order).alias("first")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = written(first, "first")
    best = written(first.groupBy("label").agg(F.min("first").alias("best")), "best")
    of_node = written(first.join(best, "label").select("node", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("kept_row")), "classes")
    for t in (labels, first, best):
        discard(t)
    return members.join(of_node, "node").select("doc_id", "row", "class_id", (F.col("row") == F.col("kept_row")).alias("kept"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every row."""
    return _classes(numbered(docs.select("doc_id", "text"))).drop("row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class."""
    placed = numbered(docs)
    gone = written(_classes(placed).where("not kept").select(F.col("row").alias(ROW)), "duplicates")
    return placed.join(gone, ROW, "left_anti").drop(ROW)
