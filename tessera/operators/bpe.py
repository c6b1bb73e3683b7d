"""Byte-level BPE training (T5) and encoding with merges (T6) on Spark.

Training works on the distinct-word table from T4 (word, count): each word is its sequence of byte symbols.  A round
makes as many merges as it can prove from a small summary of the words, in three Spark jobs:

1. Adjacent pairs are counted over all words (partial + final aggregation).  Some ``head`` of the most frequent, all pairs of
   some count or more, are the round's candidates; the next lower count is the cut.
2. Each word is split where two neighbours are no candidate pair.  The pieces ("chains") are counted over all words.  A pair,
   of old or of new symbols, whose seam lies between pieces occurs no more often than that seam's own pair: at most cut times.
   Every other occurrence lies within a chain.  So as long as the most frequent pair of the chains stands above the
   cut it is the most frequent of all, and the merges follow from the chains alone: a table of pair counts with an index
   pair -> chains, updated only from the chains a merge touches.
3. The words that hold a merged pair are rewritten by the round's merges in order, into a table of the shared folder; the
   former one is deleted.

The driver holds at most ``MOST_PAIRS`` pairs and ``MOST_CHAINS`` chains: where more chains differ, the head is halved until they fit; at
last the first pair alone is merged (it has one chain, or one per length of a run).  The public trainer's order is kept (count descending, then smaller ids), and so is its rule that a merge
whose text is in the vocabulary already takes that id.
"""

from __future__ import annotations

import heapq
import re
import time
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.tokens import ADDED_TOKENS, BYTE_IDS, N_SPECIAL, TOKEN_ID, byte_id_expr, byte_symbol_table
from tessera.operators.tokenizer import PRETOKENIZE_PATTERN, id_lists, row_pieces
from tessera.session import drop_table, shared_table

FIRST_MERGE_ID = N_SPECIAL + 256


def raw_byte_ids(text) -> Column:
    """UTF-8 bytes of a string as byte-symbol ids (no added-token splitting: training sees raw text)."""
    t = F.col(text) if isinstance(text, str) else text
    latin = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    return F.transform(F.filter(F.split(latin, ""), lambda ch: F.length(ch) > 0), lambda ch: byte_id_expr(F.ascii(ch)))


#: Bounds on what a round brings to the driver, and the least number of its candidate pairs where they allow it.
MOST_PAIRS, MOST_CHAINS, HEAD = 20_000, 50_000, 512


class ChainTrainer:
    """Merges in order over a bounded table of chains; ``texts`` maps bytes to ids and grows with the vocabulary."""

    def __init__(self, chains: list[tuple[tuple, int]], texts: dict[bytes, int], names: dict[int, bytes]):
        self.texts, self.names = texts, names
        self.chains = [list(c) for c, _ in chains]
        self.times = [n for _, n in chains]
        self.count: Counter = Counter()
        self.index: dict = defaultdict(set)
        for k, c in enumerate(self.chains):
            for pair in zip(c, c[1:]):
                self.count[pair] += self.times[k]
                self.index[pair].add(k)
        self.queue = [(-n, pair) for pair, n in self.count.items()]
        heapq.heapify(self.queue)

    def top(self) -> tuple[tuple, int] | None:
        """The most frequent pair, smaller ids first among equals; entries whose count has changed are put right as they come up."""
        while self.queue:
            n, pair = self.queue[0]
            now = self.count[pair]
            if now == -n and now > 0:
                return pair, now
            heapq.heappop(self.queue)
            if now > 0:
                heapq.heappush(self.queue, (-now, pair))
        return None

    def merge(self, pair: tuple) -> tuple[int, bool]:
        """Replace the pair wherever it stands; returns its id and whether its text is new to the vocabulary."""
        text = self.names[pair[0]] + self.names[pair[1]]
        fresh = text not in self.texts
        made = self.texts.setdefault(text, len(self.texts) + N_SPECIAL)
        self.names[made] = text
        grown = set()
        for k in self.index.pop(pair):
            old = self.chains[k]
            new = replace_pair(old, pair, made)
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                self.count[p] -= self.times[k]
            for p in zip(new, new[1:]):
                self.count[p] += self.times[k]
                self.index[p].add(k)
                grown.add(p)
            self.chains[k] = new
        for p in grown:
            heapq.heappush(self.queue, (-self.count[p], p))
        return made, fresh


def replace_pair(symbols: list, pair: tuple, made: int) -> list:
    """Occurrences of ``pair`` from left to right become ``made``."""
    a, b = pair
    out, i, n = [], 0, len(symbols)
    while i < n:
        if symbols[i] == a and i + 1 < n and symbols[i + 1] == b:
            out.append(made)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _adjacent(words: DataFrame) -> DataFrame:
    s = F.col("syms")
    both = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.size(s) - 1).alias("b"))
    return words.select("n", F.inline(both)).groupBy("a", "b").agg(F.sum("n").alias("c"))


def _chains(words: DataFrame, candidates: set) -> DataFrame:
    """Pieces of two symbols and more of each word, cut where neighbours are no candidate pair, with their counts."""
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def cut(column: pd.Series) -> pd.Series:
        out = []
        for symbols in column:
            s = symbols.tolist()
            pieces, piece = [], s[:1]
            for pair in zip(s, s[1:]):
                if pair in candidates:
                    piece.append(pair[1])
                else:
                    if len(piece) > 1:
                        pieces.append(piece)
                    piece = [pair[1]]
            out.append(pieces + [piece] if len(piece) > 1 else pieces)
        return pd.Series(out, dtype="object")

    return words.select("n", F.explode(cut("syms")).alias("chain")).groupBy("chain").agg(F.sum("n").alias("n"))


def _apply(words: DataFrame, ranks: dict) -> DataFrame:
    """Words after the merges ``{pair: (rank, id)}`` in order of rank; a lone symbol has no pair left and goes."""
    table = words.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def merged(column: pd.Series) -> pd.Series:
        return pd.Series([bpe_word(s.tolist(), table.value) for s in column], dtype="object")

    return words.select("n", merged("syms").alias("syms")).where(F.size("syms") > 1)


def train_bpe(word_counts: DataFrame, vocab_size: int = 6400, word: str = "word", count: str = "n", head: int = HEAD,
              most_chains: int = MOST_CHAINS, rounds: list | None = None) -> DataFrame:
    """T5: ordered merges ``(rank, left, right, id, count)`` until the vocabulary holds ``vocab_size`` ids or no pair is left.

    ``rounds``, a list, takes (merges, chains, seconds) of each round."""
    spark = word_counts.sparkSession
    words, path = shared_table(word_counts.select(F.col(count).cast("long").alias("n"), raw_byte_ids(word).alias("syms")).where(F.size("syms") > 1), "bpe")
    names = {BYTE_IDS[b]: bytes([b]) for b in range(256)}
    texts = {t: i for i, t in names.items()}
    merges: list = []
    while N_SPECIAL + len(texts) < vocab_size:
        begun = time.monotonic()
        top = [(r.a, r.b, r.c) for r in _adjacent(words).orderBy(F.desc("c"), "a", "b").limit(MOST_PAIRS + 1).collect()]
        # widths of the head after which a lower count follows, or none
        levels = [k for k in range(1, len(top)) if top[k][2] < top[k - 1][2]] + [len(top)] * (0 < len(top) <= MOST_PAIRS)
        fits = [k for k in levels if k < head] + [k for k in levels if k >= head][:1]
        chains: list = []
        while fits:
            chains = _chains(words, {(a, b) for a, b, _ in top[:fits[-1]]}).limit(most_chains + 1).collect()
            if len(chains) <= most_chains:
                break
            fits = [k for k in fits if k <= fits[-1] // 2]
        single = not fits and bool(top)
        if single:
            chains = _chains(words, {top[0][:2]}).collect()
        floor = 0 if single or not fits or fits[-1] == len(top) else top[fits[-1]][2]
        trainer = ChainTrainer([(tuple(r.chain), r.n) for r in chains], texts, names)
        ranks: dict = {}
        while N_SPECIAL + len(texts) < vocab_size and (best := trainer.top()):
            if best[1] <= floor or (single and ranks):
                break
            made, fresh = trainer.merge(best[0])
            ranks[best[0]] = (len(ranks), made)
            merges.append((len(merges), *best[0], made, best[1]))
            if not fresh:  # a symbol of two derivations: seams are no longer told by it, so count anew
                break
        if not ranks:
            break
        former = path
        words, path = shared_table(_apply(words, ranks), "bpe")
        drop_table(spark, former)
        if rounds is not None:
            rounds.append((len(ranks), len(chains), time.monotonic() - begun))
    drop_table(spark, path)
    return spark.createDataFrame(merges, "rank int, left int, right int, id int, count long")


def merge_table(merges: DataFrame) -> dict:
    """Driver copy of the merges, ``{(left, right): (rank, id)}`` -- bounded by the vocabulary size."""
    return {(r.left, r.right): (r.rank, r.id) for r in merges.collect()}


def token_bytes_table(merges: dict) -> dict:
    """id -> bytes for bytes and merged ids."""
    out = {BYTE_IDS[b]: bytes([b]) for b in range(256)}
    for (a, b), (_, i) in sorted(merges.items(), key=lambda kv: kv[1][0]):
        out[i] = out[a] + out[b]
    return out


def token_strings(merges: dict) -> dict:
    """id -> the byte-level symbol string (the vocabulary's token text)."""
    sym = dict(byte_symbol_table())
    return {i: "".join(sym[x] for x in bs) for i, bs in token_bytes_table(merges).items()}


def bpe_word(ids: list, ranks: dict) -> list:
    """Encode one pre-token: merge the adjacent pair of lowest rank, leftmost first, until none is left.

    Pairs wait in a heap by rank and place; symbols are linked, so a merge touches its neighbours alone (n log n in all)."""
    n = len(ids)
    queue = [(r[0], i, r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
    if not queue:
        return list(ids)
    heapq.heapify(queue)
    s, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        rank, i, made = heapq.heappop(queue)
        j = after[i]
        if s[i] is None or j >= n or ranks.get((s[i], s[j])) != (rank, made):
            continue  # one of the two was merged meanwhile
        s[i], s[j], after[i] = made, None, after[j]
        if after[i] < n:
            before[after[i]] = i
            if r := ranks.get((made, s[after[i]])):
                heapq.heappush(queue, (r[0], i, r[1]))
        if before[i] >= 0 and (r := ranks.get((s[before[i]], made))):
            heapq.heappush(queue, (r[0], before[i], r[1]))
    return [x for x in s if x is not None]


_ADDED_RE = "|".join(re.escape(t) for t in ADDED_TOKENS)
_SEGMENT_PATTERN = f"({_ADDED_RE})|((?:(?!{_ADDED_RE})[\\s\\S])+)"


CACHED_WORDS = 200_000


def encode_bpe_column(text, merges: DataFrame) -> Column:
    """T6 with merges as a column: added tokens split off first, the rest pre-tokenized in the JVM, then one Arrow
    pass over the word lists with a broadcast merge table (bounded by the vocabulary size) and a bounded word cache
    per task.  No shuffle."""
    ranks = merges.sparkSession.sparkContext.broadcast(merge_table(merges))
    t = F.col(text) if isinstance(text, str) else text
    added = F.array(*[F.lit(x) for x in ADDED_TOKENS])
    plain = lambda x: F.regexp_extract_all(x, F.lit(PRETOKENIZE_PATTERN), 0)
    cut = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(_SEGMENT_PATTERN), 0), lambda seg: F.when(
        F.array_contains(added, seg), F.array(seg)).otherwise(plain(seg))))
    words = F.when(F.contains(t, F.lit("<")) & F.rlike(t, F.lit(_ADDED_RE)), cut).otherwise(plain(t))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc
        cache = {x: np.array([TOKEN_ID[x]], np.int32) for x in ADDED_TOKENS}

        def ids_of(w):
            own = cache.get(w)
            if own is None:
                own = np.array(bpe_word([BYTE_IDS[b] for b in w.encode("utf-8")], ranks.value), np.int32)
                if len(cache) < CACHED_WORDS:
                    cache[w] = own
            return own

        for batch in batches:
            for at, n in row_pieces(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False) * 4):
                piece = batch.slice(at, n)
                # each distinct word of the piece is looked up once; numpy lays its ids out wherever it stands
                coded = piece.flatten().dictionary_encode()
                own = [ids_of(w) for w in coded.dictionary.to_pylist()]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                first = np.cumsum(sizes) - sizes
                word = coded.indices.to_numpy(zero_copy_only=False)
                per_word = sizes[word]
                ends = np.cumsum(per_word)
                ids = np.concatenate(own) if own else np.zeros(0, np.int32)
                if len(word):
                    ids = ids[np.repeat(first[word] - (ends - per_word), per_word) + np.arange(ends[-1])]
                words_to = np.cumsum(pc.fill_null(pc.list_value_length(piece), 0).to_numpy(zero_copy_only=False))
                offsets = np.concatenate([[0], np.concatenate([[0], ends])[words_to]]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            if not len(batch):
                yield id_lists([], np.zeros(0, bool))

    return encode(words)


def encode_bpe(df: DataFrame, text: str, key: str, merges: DataFrame, out: str = "ids") -> DataFrame:
    """T6 with merges: (key, ids) of each row, in place."""
    return df.select(key, encode_bpe_column(text, merges).alias(out))
