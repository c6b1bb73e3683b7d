"""Exact library encodings of whole texts through caches of blank-delimited chunks.

Both tokenizers cut a text into pre-tokens first, and a merge never crosses a cut.  At each single blank before a character
that is no white space there is always such a cut: byte-level pre-tokens may only begin with a blank, the word
tokenizer drops white space.  So a text falls into chunks at those blanks, and its ids are the chunks' ids in order; most
chunks are words seen before.  Of chunks not in the cache, a plain word (letters of basic Latin and Latin-1, which both
patterns take as one pre-token) with a tail of full stops and the like goes to the library's model directly; any other
is encoded by the library from the start.

Added special tokens may hold no blank (both files' don't), so they stay within a chunk and are found by the library there.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

from tessera.llm.common import BoundedCache

_CUT = re.compile(r" (?=\S)")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_TAIL = frozenset(".,;:!?")
_LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))))


class Irregular(Exception):
    """A chunk that begins with white space: the cheap split was no valid one."""


def load(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def byte_symbols(chars: str) -> dict[int, str]:
    """What the library's byte-level step makes of each character, for ``str.translate``."""
    from tokenizers.pre_tokenizers import ByteLevel
    step = ByteLevel(add_prefix_space=False, use_regex=False)
    return {ord(c): step.pre_tokenize_str(c)[0][0] for c in chars}


def word_and_tail(key: str) -> tuple[str, str] | None:
    """A plain word and the full stops and the like after it; None if the chunk is anything else."""
    if key.isascii():  # the usual cases, without a pattern
        if key.isalpha():
            return key, ""
        if key[-1:] in _TAIL and key[:-1].isalpha():
            return key[:-1], key[-1]
    plain = _PLAIN.fullmatch(key)
    return plain.groups() if plain else None


class ByteEncoder:
    """Byte-level vocabulary (blanks belong to the pre-token after them).

    ``value(ids)`` makes what the cache holds of a chunk, ``join`` makes one of several; ``parts`` returns a text's in order.
    """

    def __init__(self, path: str, value=len, join=sum, table: dict | None = None):
        self.tokenizer, self.value, self.join = load(path), value, join
        self.model, self.symbols = self.tokenizer.model, byte_symbols(" " + _LETTERS)
        self.table = table or {}
        self.tails: dict = {}
        self.chunks, self.words = BoundedCache(self._chunk, 400_000), BoundedCache(self._word, 150_000)

    def encode(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str):
        """A pre-token of plain letters, with or without the blank before it."""
        if not word.isascii() or word[0] == " ":
            word = word.translate(self.symbols)
        return self.value([t.id for t in self.model.tokenize(word)])

    def _tail(self, tail: str):
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.encode(tail)
        return self.tails[tail]

    def _chunk(self, key: str):
        if not key or key == "\n" or (key[0] != "\n" and key[0].isspace()) or (key[0] == "\n" and key[1].isspace()):
            raise Irregular
        known = self.table.get(key)
        if known is not None:
            return known
        new_line = key[0] == "\n"
        plain = word_and_tail(key[1:] if new_line else key)
        if not plain:
            return self.encode(key if new_line else " " + key)
        word, tail = plain
        out = [self._tail("\n"), self.words[word]] if new_line else [self.words[" " + word]]
        if tail:
            out.append(self._tail(tail))
        return self.join(out) if len(out) > 1 else out[0]

    def parts(self, text: str) -> list:
        """A newline between characters that are no white space begins a chunk of its own too."""
        if not text:
            return []
        try:
            first, *rest = text.replace("\n", " \n").split(" ")
            if first[:1].isspace():
                raise Irregular
            out = [self.encode(first)] if first else []
            out += map(self.chunks.__getitem__, rest)
            return out
        except Irregular:
            first, *rest = _CUT.split(text)
            return ([self.encode(first)] if first else []) + [self._plain(x) for x in rest]

    def _plain(self, key: str):
        """A chunk of the careful split: never begins with white space, may hold any inside."""
        try:
            return self.chunks[key]
        except Irregular:
            return self.encode(" " + key)


class WordEncoder(ByteEncoder):
    """Word vocabulary (white space is dropped, so a cut at any blank or newline is valid)."""

    def _chunk(self, key: str):
        plain = word_and_tail(key)
        if not plain:
            return self.encode(key)
        word, tail = plain
        own = self.words[word.lower()]
        return self.join([own, self._tail(tail)]) if tail else own

    def parts(self, text: str) -> list:
        return list(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def arrays(self, texts, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts without nulls, one text after the other, and each text's number of ids.

        Arrow splits the texts and finds the distinct chunks; Python looks up those alone, and numpy lays their ids out for
        every occurrence.  ``value`` must make bytes of ``dtype``."""
        import pyarrow as pa
        import pyarrow.compute as pc
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        values = list(map(self.chunks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))  # several times faster than to_pylist
        ids = np.frombuffer(b"".join(values), dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
        first = np.cumsum(sizes) - sizes
        chunk = coded.indices.to_numpy()
        per_chunk = sizes[chunk]
        ends = np.cumsum(per_chunk)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(first[chunk] - (ends - per_chunk), per_chunk) + np.arange(total)
        edge = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))]
        return ids[place], np.diff(edge)


def u32(ids) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def _packer(code: str):
    """Fast for short lists of ids."""
    def pack(ids: list) -> bytes:
        packed = array(code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()
    return pack


ids_u32, ids_u16 = _packer("I"), _packer("H")
