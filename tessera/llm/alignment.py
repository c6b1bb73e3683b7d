"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Tokenizer A is byte-level (``tokenizers``) and encodes a space and the text, B is a ``sentencepiece`` model that adds the space itself.
Over the bytes every token points to its farthest-right overlapping token, which is the other side's token over its last byte;
a B token that ends where an A token ends points to itself.  Doubling the successors of all tokens at once
(``next = next[next]``) leads each to the terminal token of its component, the group's label: groups are the pieces
between offsets where tokens of both sides end.

Texts are cut at single blanks and newlines between other characters.  Tokens of neither side cross such a cut (``PairEncoder`` proves
that of the model's pieces, and else takes whole texts), so both sides end there and a text's groups and links are
those of its chunks in order.  The chunks of a slice that the worker's bounded cache doesn't hold are encoded and aligned together.

Counts of id pairs over the corpus are joined back in two tiers.  Pairs of at least links / ``FREQUENT`` occurrences, so at most
``FREQUENT`` of them, are broadcast; the rest meet their counts in a shuffle, where no pair is frequent any more.

Defined results: null and empty texts, and those whose tokens' joined bytes are not the space and the text on either side, have no
tokens (zeros, an empty group column); special strings in texts are plain text; texts of any length are encoded whole,
in memory linear in their bytes; repeated rows each get their own row and count as often as they come; ties of a B id's highest
count all are best; empty tables give empty results; columns of the input other than doc_id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, text_of, text_slices, written

#: A bound on the broadcast table of pair counts: a pair in it is at least one of FREQUENT links.
FREQUENT = 1 << 17
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


class Chunk(NamedTuple):
    """What is kept of a chunk: numbers of tokens, groups and links, the groups as written, the links' pair codes."""
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: bytes


class PairEncoder:
    """Both tokenizers, and aligned chunks; a pair of ids is coded as ``a * (size of B's vocabulary) + b``."""

    def __init__(self, path_a: str, path_b: str, most: int = 200_000):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = {s: b for b, s in enumerate(_byte_symbols())}
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [added[i] if i in added else bytes(symbols[c] for c in self.a.id_to_token(i) or "")
                        for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: No piece goes on over a blank or holds a newline beside other characters, so a token never crosses a cut.
        self.cuts = not any("▁" in p.lstrip("▁") or ("\n" in p and p != "\n") for p in pieces)
        #: A blank and a plain word is one pre-token, which the model takes without the rest of the library.
        self.word, self.blank = self.a.model.tokenize, _byte_symbols()[ord(" ")]
        self.specials = any(t.isascii() and t.isalpha() for t in map(bytes.decode, added.values()))
        self.most, self.known, self.recent = most, {}, {}

    def split(self, text: str) -> list[str]:
        """Chunks of a text; the first begins with a blank if the text begins with white space or can't be cut."""
        if not text:
            return []
        if not self.cuts:
            return [" " + text]
        first, *rest = _CUT.split(text)
        return [" " + first if first[0].isspace() else first, *rest]

    def quick_split(self, texts: list[str]) -> list[list[str]]:
        """As ``split``; a text of single blanks and newlines between words needs no pattern."""
        if not self.cuts:
            return [self.split(t) for t in texts]
        out = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        odd = {k for k in set().union(*out) if not k or k == "\n" or k[-1].isspace() or k[k[0] == "\n"].isspace()}
        return out if not odd else [keys if odd.isdisjoint(keys) else self.split(t) for keys, t in zip(out, texts)]

    def chunks(self, keys: list[str]) -> list[Chunk | None]:
        """Aligned chunks; None where a side's tokens don't give back the bytes."""
        missing = [k for k in keys if k not in self.known and k not in self.recent]
        fresh = {}
        for at in range(0, len(missing), 2_000):
            part = missing[at:at + 2_000]
            for key, chunk in zip(part, self._align(part)):
                fresh[key] = chunk
        out = [self.known[k] if k in self.known else self.recent[k] if k in self.recent else fresh[k] for k in keys]
        short = {k: c for k, c in fresh.items() if len(k) <= 64}
        if len(self.known) < self.most:
            self.known.update(short)
        else:
            if len(self.recent) > self.most // 4:
                self.recent.clear()
            self.recent.update(short)
        return out

    def _align(self, keys: list[str]) -> list[Chunk | None]:
        """A chunk of a newline is encoded as it stands (B's own blank before it is taken off), others after a blank."""
        plain = [k if k[0] == "\n" else k[1:] if k[0] == " " else k for k in keys]
        raw = [k.encode() if k[0] == "\n" else (" " + x).encode() for k, x in zip(keys, plain)]
        ids_a = [[t.id for t in self.word(self.blank + k)] if k.isascii() and k.isalpha() and not self.specials else
                 self.a.encode(r.decode(), add_special_tokens=False).ids for k, r in zip(keys, raw)]
        ids_b = self.b.encode(plain, num_threads=1)
        ids_b = [b[1:] if k[0] == "\n" and self.bytes_b[b[0]] == b" " else b for k, b in zip(keys, ids_b)]
        right = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b))
                 for a, b, r in zip(ids_a, ids_b, raw)]
        kept = [i for i, ok in enumerate(right) if ok]
        out: list = [None] * len(keys)
        for i, chunk in zip(kept, self._aligned([ids_a[i] for i in kept], [ids_b[i] for i in kept])):
            out[i] = chunk
        return out

    def _aligned(self, ids_a: list, ids_b: list) -> Iterator[Chunk]:
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a = np.fromiter(chain.from_iterable(ids_a), np.int64, int(n_a.sum()))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        group_a, group_b = terminals(ends_a, ends_b)
        edge_b = np.cumsum(n_b)
        n_groups = np.diff(group_b[edge_b - 1], prepend=-1)
        shown, token_ends = written_groups(a, b, group_a, group_b)
        of_a, of_b = links(ends_a, ends_b)
        codes = a[of_a] * len(self.len_b) + b[of_b]
        n_links = np.bincount(np.searchsorted(edge_b, of_b, "right"), minlength=len(ids_a))
        shown, codes, at, of = shown.tobytes(), codes.tobytes(), 0, 0
        for x, y, g, m, end in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), token_ends[np.cumsum(n_a + n_b) - 1].tolist()):
            yield Chunk(x, y, g, m, shown[at:end], codes[8 * of:8 * (of + m)])
            at, of = end, of + m


def _byte_symbols() -> str:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, else the next from U+0100 on."""
    from tokenizers.pre_tokenizers import ByteLevel
    symbols = sorted(ByteLevel.alphabet())
    kept = [c for c in symbols if ord(c) < 256]
    moved = iter(c for c in symbols if ord(c) >= 256)
    return "".join(chr(b) if chr(b) in kept else next(moved) for b in range(256))


def encoder_of(path_a: str, path_b: str) -> PairEncoder:
    return per_worker(("pairs", path_a, path_b), lambda: PairEncoder(path_a, path_b))


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B token, from the byte offsets where they end (both sides end together at last)."""
    over_a = np.searchsorted(ends_b, ends_a)               # the B token over the last byte of each A token
    over_b = np.searchsorted(ends_a, ends_b)
    n_a = len(ends_a)
    own = np.arange(len(ends_b)) + n_a
    closed = ends_a[over_b] == ends_b if n_a else np.zeros(0, bool)
    succ = np.concatenate([over_a + n_a, np.where(closed, own, over_b)])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    number = np.cumsum(closed) - 1
    label = number[succ - n_a]
    return label[:n_a], label[n_a:]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of each overlapping pair: one pair per piece between neighbouring ends of either side."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3;`` and where each token's text ends, tokens in the order written."""
    n_groups = int(group_b[-1]) + 1 if len(group_b) else 0
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    at_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[np.cumsum(per_a) - 1]] = ord("|")
    mark[at_b[np.cumsum(per_b) - 1]] = ord(";")
    width = len(str(int(ids.max(initial=0))))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + ord("0")
    cells = np.concatenate([digits.astype(np.uint8), mark[:, None]], axis=1)
    size = np.maximum(1, np.searchsorted(10 ** np.arange(1, width + 1), ids, "right") + 1)
    shown = np.arange(width + 1) >= (width - size)[:, None]
    return cells[shown], np.cumsum(size + 1)


def align(texts: list[str], encoder: PairEncoder) -> dict:
    """Figures of each text; pair codes with their numbers of links, text after text, and where each text's begin."""
    index: dict = {}
    rows = [[index.setdefault(k, len(index)) for k in keys] for keys in encoder.quick_split(texts)]
    chunks = encoder.chunks(list(index))
    rows = [[] if any(chunks[i] is None for i in row) else row for row in rows] if None in chunks else rows
    shas = [hashlib.sha256(b"".join([chunks[i].groups for i in row])[:-1]).hexdigest() if row else "" for row in rows]
    figures = np.array([c[:4] if c else (0, 0, 0, 0) for c in chunks], np.int64).reshape(-1, 4)
    flat = np.fromiter(chain.from_iterable(rows), np.int64)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(figures[flat], axis=0)])[edges]
    n_a, n_b, n_groups, n_links = np.diff(sums, axis=0).T
    codes = np.frombuffer(b"".join(c.pairs if c else b"" for c in chunks), np.int64)
    first = np.cumsum(figures[:, 3]) - figures[:, 3]
    size = figures[flat, 3]
    each = codes[np.repeat(first[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    span = len(encoder.len_a) * len(encoder.len_b)
    key, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * span + each, return_counts=True)
    own, code = np.divmod(key, span)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": shas, "pairs": code, "times": times,
            "edges": np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])}


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (array of id pair and its links) of each text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of(text).alias("text"))
    counts = ("n_a", "n_b", "n_groups", "n_links")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, pairs array<struct<pair: long, times: long>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        encoder = encoder_of(path_a, path_b)
        for part in text_slices(batches, "text", 2 << 20):
            got = align(part.column(2).to_pylist(), encoder)
            items = pa.StructArray.from_arrays([pa.array(got["pairs"]), pa.array(got["times"])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(got[c]) for c in counts), pa.array(got["groups_sha256"], pa.string()),
                 pa.ListArray.from_arrays(pa.array(got["edges"], pa.int32()), items)],
                ["row", "doc_id", *counts, "groups_sha256", "pairs"])

    return rows.mapInArrow(run, schema)


def pieces_of(path_b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links over the corpus) and best (whether n is the highest of the pair's B id)."""
    counts = written(found.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("n")), "align-counts")
    b = F.col("pair") % size_b
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    found = written(aligned(docs, path_a, path_b, text), "align-rows", compression="zstd")
    counts = written(pair_counts(found, pieces_of(path_b)), "align-counted")
    total = found.agg(F.sum("n_links")).first()[0] or 0
    common = F.col("n") * frequent >= total
    pairs = found.select("row", F.inline("pairs"))
    met = pairs.join(F.broadcast(counts.where(common)), "pair", "left")
    sums = (F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    quick = met.where(F.col("n").isNotNull()).groupBy("row").agg(*sums)
    rare = met.where(F.col("n").isNull()).select("row", "pair", "times").join(counts.where(~common), "pair").groupBy("row").agg(*sums)
    each = quick.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return found.drop("pairs").join(each, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
