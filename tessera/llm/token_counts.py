"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A pre-token is what stands between two blanks (a newline begins one too), where the tokenizer always cuts; see ``encoding``.

1. Frequent pre-tokens are counted over all texts.  Each task keeps a Misra-Gries summary of at most ``FREQUENT`` entries, and
   summaries, one row a task, are merged in two steps.  Whatever makes up more than one in ``FREQUENT`` of all pre-tokens is
   in the table, whatever the size of the corpus.
2. Tier one, the table of these pre-tokens and their numbers of tokens, is broadcast: at most ``FREQUENT`` entries of at most
   ``LONGEST`` characters.  Arrow looks up a slice's distinct pre-tokens in it.
3. Tier two: misses are encoded once through the bounded caches of a Python worker.

Either tier changes only the speed.

Defined results: null and empty texts have 0 bytes and 0 tokens; an empty table gives no row; texts are worked on in slices of some
megabytes, of one row at least, so a very long text costs a few times its size; repeated rows each get their own row; ties for
the last places of the table fall out together; special strings inside texts count as the library takes them by default;
clashing columns of the input are replaced.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, text_of, text_slices
from tessera.llm.encoding import ByteEncoder, Irregular

LIMIT = 512
FREQUENT = 16_384
LONGEST = 64
SLICE = 4 << 20


def split_texts(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """What each text begins with, all further pre-tokens in order, and how many of these each text has."""
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    head = np.cumsum(sizes) - sizes
    further = np.ones(len(flat), bool)
    further[head] = False
    return flat.take(pa.array(head)), flat.filter(pa.array(further)), sizes - 1


class Summary:
    """Misra-Gries counts: each pruning takes the largest count that has no place from all, so a count is too small by at most one in
    ``keep`` of what was added."""

    def __init__(self, keep: int):
        self.keep, self.counts = keep, {}

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        if len(words) > self.keep:
            counts = counts - np.partition(counts, len(counts) - self.keep - 1)[len(counts) - self.keep - 1]
            words, counts = words.filter(pa.array(counts > 0)), counts[counts > 0]
        for w, n in zip(words.to_pylist(), counts.tolist()):
            self.counts[w] = self.counts.get(w, 0) + n
        if len(self.counts) > 2 * self.keep:
            self.prune()

    def prune(self) -> None:
        if len(self.counts) > self.keep:
            held = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            cut = int(np.partition(held, len(held) - self.keep - 1)[len(held) - self.keep - 1])
            self.counts = {w: n - cut for w, n in self.counts.items() if n > cut}

    def batch(self) -> pa.RecordBatch:
        self.prune()
        task = TaskContext.get()
        columns = [pa.array([task.partitionId() if task else 0], pa.int32()), pa.array([list(self.counts)], pa.list_(pa.string())),
                   pa.array([list(self.counts.values())], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "words", "counts"])


SUMMARY = "part int, words array<string>, counts array<long>"


def _summarise(keep: int):
    def run(batches):
        summary = Summary(keep)
        for part in text_slices(batches, "text", SLICE):
            _, words, _ = split_texts(part.column(0))
            found = pc.value_counts(words.filter(pc.less_equal(pc.utf8_length(words), LONGEST)))
            summary.add(found.field("values"), found.field("counts").to_numpy())
        yield summary.batch()
    return run


def _merge(keep: int):
    def run(batches):
        summary = Summary(keep)
        for batch in batches:
            words, counts = batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                summary.add(words[i].values, counts[i].values.to_numpy())
        yield summary.batch()
    return run


def frequent_words(docs: DataFrame, text: str = "text", keep: int = FREQUENT) -> list[str]:
    """Pre-tokens that make up more than one in ``keep`` of those of all texts, and others; at most ``keep``."""
    tasks = docs.select(text_of(text).alias("text")).mapInArrow(_summarise(keep), SUMMARY)
    some = tasks.repartition("part").mapInArrow(_merge(keep), SUMMARY)
    held = some.repartition(1).mapInArrow(_merge(keep), SUMMARY).first()  # one row of at most ``keep`` entries
    return sorted(held["words"]) if held else []


class Lengths(NamedTuple):
    words: pa.Array
    tokens: np.ndarray


def frequent_lengths(words: list[str], path: str) -> Lengths:
    """Tier one: the pre-tokens and the library's number of tokens of each."""
    encoder, out = ByteEncoder(path), {}
    for w in words:
        try:
            out[w] = encoder.chunks[w]
        except Irregular:  # such a text is split with more care
            continue
    return Lengths(pa.array(list(out), pa.string()), np.fromiter(out.values(), np.int64, len(out)))


class Counter:
    def __init__(self, path: str, table: Lengths):
        self.encoder, self.table = ByteEncoder(path), table

    def _miss(self, word: str) -> int:
        try:
            return self.encoder.chunks[word]
        except Irregular:
            return -1

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        heads, further, sizes = split_texts(texts)
        coded = further.dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.table.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        n = np.zeros(len(words), np.int64)
        n[known] = self.table.tokens[at.drop_null().to_numpy()]
        n[~known] = [self._miss(w) for w in words.filter(pa.array(~known)).to_pylist()]
        each = n[coded.indices.to_numpy()]
        edge = np.concatenate([[0], np.cumsum(sizes)])
        within = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
        total, odd = within(each), within(each < 0)
        for i, head in enumerate(heads.to_pylist()):
            if odd[i] or head[:1].isspace():
                total[i] = sum(self.encoder.parts(texts[i].as_py()))
            elif head:
                total[i] += self.encoder.encode(head)
        return total


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit of each whole text: one pass for the table, one narrow pass for the counts."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(frequent_words(docs, text), path))
    key = ("counts", uuid.uuid4().hex)

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        counter = per_worker(key, lambda: Counter(path, table.value))
        parts = text_slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", SLICE)
        return pa.array(np.concatenate([np.empty(0, np.int64), *(counter.count(p.column(0)) for p in parts)]), pa.int64())

    t = text_of(text)
    out = docs.withColumns({"n_bytes": F.octet_length(t).cast("long"), "n_tokens": counted(t)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
