import random

import numpy as np

from tessera.llm import decontam as D


def brute(item, text, k):
    """Greedy string tiling by trying every pair of places."""
    k = min(k, len(item))
    marked_i, marked_t, tiles = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while (a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in marked_i and b + n not in marked_t):
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return tiles
        a, b, n = best
        tiles.append(best)
        marked_i |= set(range(a, a + n))
        marked_t |= set(range(b, b + n))


def test_tiles_match_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        vocab = [f"w{i}" for i in range(rng.choice([2, 5, 30]))]
        item = [rng.choice(vocab) for _ in range(rng.randint(1, 14))]
        text = [rng.choice(vocab + ["zz"]) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = item[len(item) // 2:] + item[:len(item) // 2]
        got = list(D.Index([(1, " ".join(item))], 3).tilings(" ".join(text), 0.0))
        want = brute(item, text, 3)
        assert (got[0][2] if got else []) == want, (item, text)


def test_hash_collisions_are_no_matches(monkeypatch):
    monkeypatch.setattr(D, "_BASE", np.uint64(0))  # hashes see the last word only
    index = D.Index([(1, "a b c d e")], 3)
    assert list(index.tilings("x y c d z", 0.0)) == []
    assert list(index.tilings("q a b c d e", 0.5))[0][2] == [(0, 1, 5)]


def test_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage), (2, "short one"), (3, None), (4, "..."), (1, passage)], "item_id long, text string")
    moved = "x seven eight nine ten eleven twelve y One, two; three four-five six z"
    docs = [(1, passage.upper(), "c"), (2, moved, "c"), (3, None, "c"), (4, "", "c"), (5, "one two three four other words", "c"), (6, "a short one", "c"),
            (7, "pad " * 20_000 + passage + " pad" * 20_000, "c"), (8, (passage + " ") * 2000, "c"), (2, moved, "c"), (9, "clean words only here", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    rows = D.tilings(df, items).collect()
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in rows)
    assert got == sorted([(d, 1, 1.0) for d in (1, 2, 2, 7, 8) for _ in range(2)] + [(6, 2, 1.0)])
    assert {r.n_tiles for r in rows if r.doc_id == 2} == {2}
    kept = {r.doc_id for r in D.with_coverage(df, items).where("coverage < 0.5").collect()}
    assert kept == {3, 4, 5, 9}
    assert D.tilings(df, items.limit(0)).count() == 0 and D.tilings(df.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(30)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"x a{i} b{i} c{i} d{i} e{i} y") for i in range(30)], "doc_id long, text string")
    whole = sorted((r.doc_id, r.item_id, r.coverage) for r in D.tilings(df, items).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in D.tilings(df, items).collect()) == whole
    assert D.with_coverage(df, items).where("coverage = 1").count() == 30
