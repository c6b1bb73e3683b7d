"""Runs against a scan of all periods, and the query against the same over its whole table."""
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from tessera.llm import periodic as P
from tessera.llm.queries import QUERIES


def all_runs(words):
    """For each period, stretches in which words that far apart are equal; of one stretch the least period counts."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(i, j) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def expected(text, words):
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(left))


def test_cover_gives_every_difference():
    assert {(a - b) % P.V for a in P.COVER for b in P.COVER} == set(range(P.V))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=150), st.data())
def test_extensions(words, data):
    laid, _ = P._lay_out([np.array(words + words, np.int64)])
    lce = P.Lce(laid)
    for _ in range(5):
        b = data.draw(st.integers(1, len(laid)))
        a = data.draw(st.integers(0, b - 1))
        n = 0
        while b + n < len(laid) and laid[a + n] == laid[b + n]:
            n += 1
        assert lce.query(np.array([a]), np.array([b]))[0] == n


def test_runs_of_many_texts():
    rng = random.Random(7)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 6, 7, 40, 200]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), 1 + n // rng.randint(3, 12)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(w, np.int64))
        for text, got in zip(texts, P.find_runs(texts)):
            assert [tuple(r) for r in got.tolist()] == all_runs(text.tolist())


def test_edge_texts_and_columns(spark):
    long = " ".join(["x y z"] * 30_000)
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "a a a a a a", "d"), (4, "a a a a a a", "d"), (5, "a\x0ba\x0ca a a b", "e"), (None, "p q " * 4, "f"),
            (6, long, "g"), (7, "u" * 300_000, "h"), (8, " a a", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = P.with_runs(docs).collect()
    assert len(out) == len(rows) and set(P.with_runs(docs).columns) == {"doc_id", "text", "runs", "best", "collapsed"}
    got = {r.doc_id: r for r in out}
    assert got[1].runs == got[2].runs == got[3].runs == got[5].runs == got[8].runs == [] and got[1].best is None and got[1].collapsed == ""
    assert got[4].runs == [(0, 6, 1)] and got[4].collapsed == "a" and got[4].best.exponent_milli == 6000
    assert got[None].runs == [(0, 8, 2)] and got[None].collapsed == "p q"
    assert got[6].runs == [(0, 90_000, 3)] and got[6].collapsed == "x y z"
    assert P.digests(docs.limit(0)).collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()}
    assert set(rows) == set(texts)
    planted = 0
    for i, t in texts.items():
        words = [w.decode() for w in t.encode().split()]
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        assert rows[i] == expected(t, words), i
    assert planted
