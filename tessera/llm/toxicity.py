"""Toxicity by noisy-channel deobfuscation and a learnt word model.

1. A character language model (4-grams over 28 symbols) is counted over all documents, partial counts first.  Its
   table has 28**4 cells whatever the corpus, which bounds what is collected and broadcast.
2. ``Decoder.restore`` turns a suspicious piece of text (leet characters between letters, letters parted by
   separators or white space, doubled letters, look-alike letters) into a lattice: each character may stand for itself, for a letter it imitates, for the
   letter before it, or for nothing.  Viterbi finds the cheapest path of channel costs and language model.
3. Words of restored text are scored by their likeliest feature (the word or a prefix of it): the share of toxic
   documents among those of the training sample that hold it, drawn towards the base rate.  A document's share is that
   of its worst word; the share that parts the training sample best, each document left out of its own counts, becomes
   score 0.5.

The classifier is fitted on at most ``fit_rows`` labelled documents outside the held-out fold, chosen by a hash of
doc_id, near copies counted once.  Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts hold no word and score the base rate halved; repeated rows each get their own row;
labels that are null are not learnt from; of several labels of a document all count; without any training row
every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BoundedCache, discard, held_out, per_worker, row_chunks, text_of, written

# ---- character language model ---------------------------------------------------------------------------------------

A = 28  # 0: anything between words, 1-26: a-z, 27: another letter
ORDER = 4
CELLS = A ** ORDER

_LUT = np.zeros(256, np.int32)
for _i in range(26):
    _LUT[97 + _i] = _LUT[65 + _i] = 1 + _i
_LUT[0xC3:0xF5] = 27  # first byte of another character, nearly always a letter
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True  # its other bytes


def _count_batches(batches):
    import pyarrow as pa
    total = np.zeros(CELLS, np.int64)
    for (texts,) in row_chunks(batches, ["text"], 64):
        raw = np.frombuffer(b"\n\n\n".join(t.encode() for t in texts), np.uint8)
        raw = raw[~_TAIL[raw]]
        s = _LUT[raw]
        if len(s) >= ORDER:
            code = ((s[:-3] * A + s[1:-2]) * A + s[2:-1]) * A + s[3:]
            total += np.bincount(code, minlength=CELLS)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])


def char_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs -log P(symbol | the three before) from the counts over all documents, as float32 of 28**4 cells.

    The driver gets at most 28**4 summed cells."""
    counts = (docs.select(text_of(text).alias("text")).mapInArrow(_count_batches, "cell long, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")))
    n = np.zeros(CELLS)
    rows = counts.toArrow()
    n[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return smoothed(n.reshape((A,) * ORDER)).astype(np.float32)


def smoothed(n: np.ndarray) -> np.ndarray:
    """Witten-Bell: each order is mixed with the next lower one by how many symbols followed its context."""
    p = np.full(A, 1.0 / A)
    for order in range(1, ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - order))) if order < ORDER else n
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = (c + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1))
    return -np.log(p).reshape(-1)


# ---- noisy channel --------------------------------------------------------------------------------------------------

# Characters and the letters they imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
        "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¢": "c", "§": "s"}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "һ": "h", "ј": "j", "ո": "n",
              "ο": "o", "α": "a", "ι": "i", "ν": "v", "κ": "k", "τ": "t", "ρ": "p", "ѵ": "v", "ɡ": "g", "ı": "i", "ɑ": "a"}
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x034F], None)
SEPARATORS = " .-_*~'`,/\\:;^="

KEEP, IMITATE, DROP_SEPARATOR, KEEP_SEPARATOR, DROP_REPEAT, DROP_JUNK = 0.05, 2.0, 1.2, 2.5, 1.0, 4.0

_LETTERS = r"[^\W\d_]"
_LEET_CLASS = re.escape("".join(LEET)).replace(" ", "")
_LOOKALIKE = f"[{''.join(HOMOGLYPHS)}]"
#: A letter and a leet character side by side, a separator between letters, a letter three times, three doubled letters, or a look-alike letter.
_ODD = re.compile(rf"(?:{_LETTERS}[{_LEET_CLASS}]|[{_LEET_CLASS}]{_LETTERS})|{_LETTERS}[.\-_*~'`,/\\:;^=]+{_LETTERS}|({_LETTERS})\1\1|(?:({_LETTERS})\2){{3}}|{_LOOKALIKE}")
_LETTERS_ODD = re.compile(rf"({_LETTERS})\1\1|(?:({_LETTERS})\2){{3}}|{_LOOKALIKE}")
#: Words of the language hold doubled letters too, so a token that is odd by these alone has two readings.
_DOUBLED = re.compile(rf"({_LETTERS})\1")
#: Three or more single characters, each parted from the next by white space.
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SPACED_HINT = re.compile(r"\s\S\s+\S\s+\S\s")


_HIDDEN = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")


def normal(text: str) -> str:
    """Lower case, compatibility forms as plain ones, without invisible characters."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = text.translate(INVISIBLE)
    return text.lower()


def _symbol(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 if ch.isalpha() else 0


class Decoder:
    """Viterbi over the lattice of a piece; ``costs`` is what ``char_model`` returns."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist() if len(costs) else [0.0] * CELLS

    def options(self, piece: str, i: int, spaced: bool) -> list[tuple[str, float]]:
        """What the i-th character may stand for, with channel costs; "" stands for nothing."""
        ch = piece[i]
        if ch.isalpha():
            out = [(ch, KEEP)]
            if ch in HOMOGLYPHS:
                out.append((HOMOGLYPHS[ch], KEEP))
            if i and piece[i - 1] == ch:
                out.append(("", DROP_REPEAT))
            elif spaced and i > 1 and piece[i - 2] == ch:
                out.append(("", DROP_REPEAT))
            return out
        out = [(x, IMITATE) for x in LEET.get(ch, "")]
        if ch in SEPARATORS:
            out += [("", DROP_SEPARATOR), (ch, KEEP_SEPARATOR if spaced and ch == " " else KEEP)]
        else:
            out += [(ch, KEEP if not out else IMITATE + 0.5), ("", DROP_JUNK)]
            if i and piece[i - 1] == ch and ch in LEET:
                out.append(("", DROP_REPEAT))
        return out

    def decode(self, piece: str) -> str:
        """The cheapest reading.  A state is the last three symbols, so the work is linear in the length."""
        spaced = " " in piece
        costs, limit = self.costs, A ** 3
        states = {0: (0.0, None)}  # context -> (cost, back pointer (text, pointer))
        for i in range(len(piece)):
            nxt: dict = {}
            for out, channel in self.options(piece, i, spaced):
                for context, (cost, back) in states.items():
                    if out:
                        cell = context * A + _symbol(out)
                        new, c, b = cell % limit, cost + channel + costs[cell], (out, back)
                    else:
                        new, c, b = context, cost + channel, back
                    if new not in nxt or c < nxt[new][0]:
                        nxt[new] = (c, b)
            states = nxt
        _, back = min(((cost + costs[context * A], back) for context, (cost, back) in states.items()), key=lambda x: x[0])
        out = []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def token(self, token: str) -> str:
        """A token of normal text, restored; one that is not odd is left as it is."""
        odd = _LETTERS_ODD if token.strip(".,").isalpha() else _ODD
        return self.decode(token) if odd.search(token) else token

    def readings(self, token: str) -> list[str]:
        """The token restored and, if only doubled letters are odd in it, both as it is and decoded."""
        own = self.token(token)
        return [own, self.decode(token)] if own == token and _DOUBLED.search(token) else [own]

    def spaced_runs(self, t: str) -> list[str]:
        """Readings of the runs of single characters in a normal text: each run as a whole and, where its gaps differ, also
        its parts between the wider gaps."""
        if not _SPACED_HINT.search(f" {t} "):
            return []
        out = []
        for run in (m[0] for m in _SPACED.finditer(t) if any(c.isalpha() for c in m[0])):
            out.append(self._spaced(run))
            gaps = re.findall(r"\s+", run)
            if len(set(map(len, gaps))) > 1:
                parts = re.split(rf"\s{{{min(map(len, gaps)) + 1},}}", run)
                out += [self._spaced(x) for x in parts if len(x.split()) > 2]
        return out

    def _spaced(self, run: str) -> str:
        return self.decode(" ".join(run.split()))

    def restore(self, text: str) -> str:
        """The whole text, restored: spaced runs first, then each token."""
        t = normal(text)
        if _SPACED_HINT.search(f" {t} "):
            t = _SPACED.sub(lambda m: self._spaced(m[0]) if any(c.isalpha() for c in m[0]) else m[0], t)
        return re.sub(r"\S+", lambda m: self.token(m[0]), t)


# ---- classifier -----------------------------------------------------------------------------------------------------

FIT_ROWS = 20_000  # most labelled documents a fit reads
PRIOR = 4.0        # weight of the base rate in a feature's share
LEAST_TOXIC = 3    # toxic training documents a feature must stand in
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(rf"{_LETTERS}+")


@dataclass
class Model:
    costs: np.ndarray
    shares: dict
    base: float
    cut: float = 0.5  # share that becomes score 0.5


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def _features_of(words) -> set:
    return {f for w in words for f in features(w)}


class Scorer:
    """Words and scores of whole texts; tokens seen before come from a bounded cache."""

    def __init__(self, model: Model):
        self.decoder, self.shares, self.floor, self.cut = Decoder(model.costs), model.shares, model.base / 2, model.cut
        self.heads = {f[:4] for f in self.shares} | {f for f in self.shares if len(f) < 4}
        self.tokens = BoundedCache(self._token)

    def words(self, text: str) -> set:
        """The distinct words of the restored text."""
        t = normal(text)
        pieces = [p for x in set(t.split()) for p in self.decoder.readings(x)] + self.decoder.spaced_runs(t)
        return {w for p in pieces for w in _WORD.findall(p)}

    def _worst(self, text: str) -> float:
        best, get = self.floor, self.shares.get
        for w in _WORD.findall(text):
            if w[:4] in self.heads:
                best = max([best, *(get(f, 0.0) for f in features(w))])
        return best

    def _token(self, token: str) -> float:
        return max(map(self._worst, self.decoder.readings(token)))

    def share(self, text: str) -> float:
        t = normal(text)
        best = max(map(self.tokens.__getitem__, t.split()), default=self.floor)
        return max([best, *map(self._worst, self.decoder.spaced_runs(t))])

    def score(self, text: str) -> float:
        s, cut = self.share(text), self.cut
        return 0.5 * s / cut if s < cut else 0.5 + 0.5 * (s - cut) / (1 - cut)


def _words_of_batches(shared, key):
    """Per training document: its distinct words, its near-copy group (its four least word hashes), its label."""
    def run(batches):
        import pyarrow as pa
        scorer = per_worker(("words", key), lambda: Scorer(shared.value))
        for texts, labels in row_chunks(batches, ["text", "toxic"], 64):
            found = [sorted(scorer.words(t)) for t in texts]
            groups = [xxhash.xxh64_intdigest(repr(sorted(map(xxhash.xxh64_intdigest, w))[:4])) >> 1 for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.string()))],
                                             ["grp", "toxic", "words"])
    return run


def _feature_counts(wanted):
    """Documents and toxic documents by feature, summed within the task; ``wanted``: None or the features to count."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa
        n, bad = Counter(), Counter()
        for words, labels in row_chunks(batches, ["words", "toxic"], 64):
            for w, toxic in zip(words, labels):
                own = _features_of(w) if wanted is None else _features_of(w) & wanted.value
                n.update(own)
                if toxic:
                    bad.update(own)
        yield pa.RecordBatch.from_pydict({"feature": list(n), "n": list(n.values()), "bad": [bad[f] for f in n]})
    return run


def _summed(rows: DataFrame, wanted=None) -> DataFrame:
    return (rows.select("words", "toxic").mapInArrow(_feature_counts(wanted), "feature string, n long, bad long")
            .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))


def _best_cut(shares: np.ndarray, toxic: np.ndarray) -> float:
    """The share that parts the training sample with the fewest errors; of several, the middle of the widest gap."""
    if not toxic.any() or toxic.all():
        return 0.5
    values, at = np.unique(shares, return_inverse=True)
    bad = np.bincount(at, weights=toxic, minlength=len(values))
    good = np.bincount(at, minlength=len(values)) - bad
    errors = np.concatenate([[good.sum()], bad.cumsum() + good.sum() - good.cumsum()])[1:-1]
    if not len(errors):
        return 0.5
    cuts, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    best = errors == errors.min()
    return float(np.clip(cuts[best][gaps[best].argmax()], 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Character model over all documents; feature shares and the cut from the training sample."""
    spark = docs.sparkSession
    model = Model(char_model(docs), {}, 0.0)
    pool = (labels.select(F.col("doc_id").alias("__llm_id"), F.col("toxic").cast("int").alias("toxic"))
            .where(F.col("toxic").isNotNull() & F.col("__llm_id").isNotNull() & ~held_out("__llm_id")))
    share = min(1.0, 1.2 * fit_rows / max(pool.count(), 1))
    chosen = (pool.where(F.pmod(F.xxhash64("__llm_id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
              .orderBy(F.xxhash64("__llm_id"), "__llm_id", "toxic").limit(fit_rows))
    # at most fit_rows short rows on the broadcast side
    sample = (docs.select(F.col("doc_id").alias("__llm_id"), text_of("text").alias("text"))
              .join(F.broadcast(chosen), "__llm_id").select("text", "toxic"))
    shared = spark.sparkContext.broadcast(model)
    seen = written(sample.mapInArrow(_words_of_batches(shared, uuid.uuid4().hex), "grp long, toxic int, words array<string>")
                   .groupBy("grp", "toxic").agg(F.min("words").alias("words")), "toxic-words")  # the same copy at every run
    total, toxic = seen.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if not total:
        return model
    model.base = toxic / total
    # features of at least LEAST_TOXIC toxic documents of the bounded sample
    held = _summed(seen.where("toxic > 0")).where(F.col("n") >= LEAST_TOXIC).select("feature").toArrow()
    wanted = spark.sparkContext.broadcast(set(held.column("feature").to_pylist()))
    counts = {f: (n, bad) for f, n, bad in _summed(seen, wanted).toArrow().to_pandas().itertuples(index=False)}
    base = model.base
    model.shares = {f: (bad + PRIOR * base) / (n + PRIOR) for f, (n, bad) in counts.items() if bad >= 0.25 * n}
    shared_counts = spark.sparkContext.broadcast(counts)

    @F.pandas_udf("double")
    def worst(words, toxic):
        """A training document's share as if it had not been learnt from."""
        import pandas as pd
        get = shared_counts.value.get
        out = []
        for w, y in zip(words, toxic):
            own = [get(f) for f in _features_of(w)]
            out.append(max([base / 2, *((c[1] - y + PRIOR * base) / (c[0] - 1 + PRIOR) for c in own if c)]))
        return pd.Series(out, dtype="float64")

    rows = seen.select(worst("words", F.signum("toxic").cast("int")).alias("share"), "toxic").toArrow()
    model.cut = _best_cut(rows.column("share").to_numpy(), rows.column("toxic").to_numpy() > 0)
    discard(seen)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each whole text: one narrow pass; the model is bounded by its cells and its sample."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd
        scorer = per_worker(("scorer", key), lambda: Scorer(shared.value))
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(text_of(text)))


def restore(docs: DataFrame, model: Model, text: str = "text", out: str = "restored") -> DataFrame:
    """Adds the restored text."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("string")
    def restored(texts):
        import pandas as pd
        decoder = per_worker(("restorer", key), lambda: Decoder(shared.value.costs))
        return pd.Series([decoder.restore(t) for t in texts], dtype="object")

    return docs.withColumn(out, restored(text_of(text)))
