"""Alignment against a comparison of all token spans of both libraries' whole encodings."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from tessera.llm import alignment as A
from tessera.llm.queries import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return A.PairEncoder(*PATHS)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def by_hand(text, enc):
    """n_a, n_b, n_groups, n_links, groups and links of a text encoded as one."""
    if not text:
        return 0, 0, 0, 0, "", Counter()
    a, b, raw = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text), (" " + text).encode()
    if b"".join(enc.bytes_a[i] for i in a) != raw or b"".join(enc.bytes_b[i] for i in b) != raw:
        return 0, 0, 0, 0, "", Counter()
    left, right = spans(a, enc.bytes_a), spans(b, enc.bytes_b)
    cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    pairs, k = Counter(), 0
    for s, e, i in left:
        while right[k][1] <= s:
            k += 1
        m = k
        while m < len(right) and right[m][0] < e:
            pairs[i, right[m][2]] += 1
            m += 1
    said, at = [], 0
    for cut in cuts:
        said.append("|".join(",".join(str(i) for s, e, i in side if at <= s < cut) for side in (left, right)))
        at = cut
    return len(a), len(b), len(cuts), sum(pairs.values()), hashlib.sha256(";".join(said).encode()).hexdigest(), pairs


def figures(got, k):
    part = slice(got["edges"][k], got["edges"][k + 1])
    pairs = Counter({(int(p) // 32_000, int(p) % 32_000): int(n) for p, n in zip(got["pairs"][part], got["times"][part])})
    return (*(int(got[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")), got["groups_sha256"][k], pairs)


PIECES = ["a", "the", "word", " ", "  ", "\n", "\n\n", "\t", "é", "漢字", "▁", "<s>", "<|endoftext|>", "</s>", "<0x41>", "😀", ".", "'s", "123", "\r\n",
          " ", "　", "\x00", "é", "\x1c", "foo bar baz", "strasse", " ", " ", " "]


def test_random_texts(encoder):
    rng = random.Random(3)
    for _ in range(400):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        got = A.align(texts, encoder)
        for k, t in enumerate(texts):
            assert figures(got, k) == by_hand(t, encoder), t


def test_pointers_meet_where_both_sides_end():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
        cuts = sorted(set(a) & set(b))
        group_a, group_b = A.terminals(np.array(a), np.array(b))
        assert group_a.tolist() == np.searchsorted(cuts, a).tolist() and group_b.tolist() == np.searchsorted(cuts, b).tolist()


def test_without_cuts_and_with_a_small_cache(encoder):
    whole = A.PairEncoder(*PATHS, most=3)
    whole.cuts = False
    for t in ("one two\nthree", " x", "a  b", "one two\nthree"):
        assert figures(A.align([t], whole), 0) == figures(A.align([t], encoder), 0)


def test_query(spark, encoder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    hand = {i: by_hand(t, encoder) for i, t in texts.items()}
    corpus = sum((h[5] for h in hand.values()), Counter())
    most = Counter()
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    rows = QUERIES["op12_token_alignment"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        h = hand[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == h[:5]
        assert r.n_best == sum(n for p, n in h[5].items() if corpus[p] == most[p[1]])
        assert r.count_sum == sum(n * corpus[p] for p, n in h[5].items())


def test_edges(spark, encoder):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a▁b", "x"), (4, "two words", "x"), (4, "two words", "x"), (None, "two", "x"), (5, "long " * 40_000, "x"), (6, "z" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    for bound in (1, 1 << 17):  # next to nothing, then everything, through the broadcast
        out = A.with_counts(docs, *PATHS, frequent=bound).collect()
        assert len(out) == len(rows)
        got = {r.doc_id: r for r in out}
        assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(0,) * 6 + ("",)] * 3
        assert got[4].n_links == got[4].n_best == 2 and got[4].count_sum == 3 + 2 and got[5].n_a == 40_001
        assert sum(r.n_links for r in out if r.doc_id == 4) == 4
    assert A.with_counts(docs.limit(0), *PATHS).collect() == []
