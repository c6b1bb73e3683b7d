import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import dedup as D


def windows(text):
    """Labelled k-mers, by definition."""
    words = D.words_of(text)
    k = min(D.K, len(words))
    seen, out = defaultdict(int), []
    for i in range(len(words) - k + 1 if words else 0):
        w = tuple(words[i:i + k])
        out.append((w, seen[w]))
        seen[w] += 1
    return out


def alignment(a, b):
    """Longest common subsequence of the labelled k-mers, by dynamic programming."""
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    n = best[-1, -1]
    return n / max(1, len(a) + len(b) - n)


def edit_similarity(a, b):
    """1 - edit distance of words / longer length, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(1, len(a), len(b))


def brute_classes(texts, least=0.8):
    """texts: id -> text.  Least id of each connected component of similar pairs: windows at 0.8, words at ``least``."""
    w = {i: windows(t or "") for i, t in texts.items()}
    plain = {i: " ".join(D.words_of(t or "")) or "t " + (t or "").strip() for i, t in texts.items()}
    label = {i: i for i in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = plain[i] == plain[j]
            if not same and min(len(w[i]), len(w[j])) >= 1 and min(len(D.words_of(texts[i])), len(D.words_of(texts[j]))) >= D.K:
                common = len(set(w[i]) & set(w[j]))
                same = common >= 0.8 * (len(w[i]) + len(w[j]) - common) and alignment(w[i], w[j]) >= 0.8
                x, y = D.words_of(texts[i]), D.words_of(texts[j])
                if not same and min(len(x), len(y)) >= least * max(len(x), len(y)):
                    same = edit_similarity(x, y) >= least
                if not same:
                    x, y = ([k for k in w[n] if k[1] == 0] for n in (i, j))
                    common = len(set(x) & set(y))
                    same = common >= 0.8 * (len(x) + len(y) - common) and alignment(x, y) >= 0.8
            if same:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed, bases, copies):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, copies)):
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], rng.choice(vocab)]])
            texts[n] = " ".join(words).capitalize() + rng.choice([".", "!", ""])
            n += 1
    return texts


def run(spark, texts, docs=None):
    df = docs or spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in D.classes(df).collect()}


def test_similarity_is_the_alignment():
    rng = random.Random(2)
    h = D.Hasher()
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))]
        b = a[:]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice([[], ["z"], [b[at], "y"]])
        if rng.random() < 0.2:
            b = b[len(b) // 2:] + b[:len(b) // 2]
        x, y = " ".join(a), " ".join(b)
        exact = alignment(windows(x), windows(y))
        got = D.similarity(h.kmers(D.words_of(x)), h.kmers(D.words_of(y)))
        assert got == pytest.approx(exact) if exact >= 0.8 else got <= exact + 1e-9 or got < 0.8


def test_repeated_passages_do_not_part_copies():
    h = D.Hasher()
    line, rest = [f"l{i}" for i in range(12)], [f"r{i}" for i in range(60)]
    a, b = (D.Prepared(line * n + rest, h) for n in (2, 5))
    assert D.similarity(a.labelled[0], b.labelled[0]) < 0.8 <= D.pair_similarity(a, b)
    assert D.pair_similarity(a, D.Prepared(rest[30:] + rest[:30] + line, h)) < 0.8


def edited(rng, words, edits):
    b = words[:]
    for _ in range(edits):
        at = rng.randrange(len(b) + 1)
        b[at:at + 1] = rng.choice([[], [rng.choice(words)], b[at:at + 1] + [rng.choice(words)]])
    return b


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(7)
    for _ in range(600):
        a = [rng.choice("abcdefghijkl"[:rng.randint(1, 12)]) for _ in range(rng.randint(1, 60))]
        b = edited(rng, a, rng.randint(0, 14)) if rng.random() < 0.8 else [rng.choice("abc") for _ in range(rng.randint(1, 60))]
        exact = round((1 - edit_similarity(a, b)) * max(len(a), len(b)))
        for limit in (0, 1, 5, 20, 80):
            got = D.edit_distance(a, b, limit)
            assert got == exact if exact <= limit else got > limit
        s = edit_similarity(a, b)
        assert D.word_similarity(a, b) == pytest.approx(s if s >= 0.8 else 0)


def test_alignment_in_tiles_and_few_masks():
    """A text longer than a tile, with more different words than masks are held."""
    rng = random.Random(8)
    a = [f"w{rng.randrange(900)}" for _ in range(4000)]
    b = edited(rng, a, 150)
    masks = D._Masks(a)
    wide = D._in_band(masks, len(a), b, 400, 400)
    assert D.edit_distance(a, b, 400) == wide <= 150
    frame = masks.frame
    masks.frame = lambda *at: (frame(*at), setattr(masks, "most", 3))
    assert D._in_band(masks, len(a), b, 400, 400) == wide


def test_edited_copies_are_found(spark):
    """One word in ten or eleven changed, spread evenly: few windows in common, yet copies.  Sketches are random, so 0.9 of the
    pairs is asked for (0.95 are expected), and no pair of other texts."""
    rng = random.Random(3)
    texts = {}
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(rng.randint(80, 200))]
        other = [f"x{g}" if i % 11 == 5 else w for i, w in enumerate(words)]
        texts[2 * g], texts[2 * g + 1] = " ".join(words), " ".join(other)
    got = {i: r.class_id for i, r in run(spark, texts).items()}
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(150)) >= 135
    assert all(c // 2 == i // 2 for i, c in got.items())


def test_classes_of_repeated_passages(spark):
    """Through all gates: texts said once, twice and three times, and a line repeated beside other words."""
    texts = {}
    for g in range(12):
        said, line, rest = ([f"{x}{g}x{i}" for i in range(n)] for x, n in (("s", 100), ("l", 12), ("r", 60)))
        for words in (said, said * 2, said * 3, line * 2 + rest, line * 5 + rest):
            texts[len(texts)] = " ".join(words)
    want = brute_classes(texts)
    assert len(set(want.values())) == 24
    assert {i: r.class_id for i, r in run(spark, texts).items()} == want


def test_labelled_kmers_differ():
    h = D.Hasher().kmers(["a"] * 3000)
    assert len(set(h.tolist())) == len(h) == 2996


def test_sketches_see_order():
    h = D.Hasher()
    words = [f"w{i}" for i in range(400)]
    a, _ = D.sketch(h.kmers(words))
    b, _ = D.sketch(h.kmers(words[200:] + words[:200]))
    c, _ = D.sketch(h.kmers(words[:399]))
    assert sum(x == y for x, y in zip(a, b)) < sum(x == y for x, y in zip(a, c))


def check_classes(texts, rows):
    """Sketches may miss pairs that share few windows.  So: all pairs that are similar by windows are together, nine tenths of those
    whose words are to 0.9, and no others than brute force joins at 0.8."""
    got = {i: r.class_id for i, r in rows.items()}
    assert {i for i, r in rows.items() if r.kept} == set(got.values()) and all(got[c] == c <= i for i, c in got.items())
    most, windowed = brute_classes(texts), brute_classes(texts, least=2)
    assert all(most[i] == most[c] for i, c in got.items())
    assert all(got[i] == got[c] for i, c in windowed.items())
    words = {i: D.words_of(t) for i, t in texts.items()}
    near = [got[i] == got[j] for i in texts for j in range(i) if most[i] == most[j] and edit_similarity(words[i], words[j]) >= 0.9]
    assert sum(near) >= 0.9 * len(near)


def test_classes_match_brute_force(spark):
    texts = corpus(4, 25, 8)
    check_classes(texts, run(spark, texts))


def test_large_buckets_lose_no_class(spark, monkeypatch):
    """With small buckets of two, everything goes through stars and refinement."""
    monkeypatch.setattr(D, "SMALL", 2)
    texts = corpus(9, 4, 40)
    check_classes(texts, run(spark, texts))


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(4, None, "c"), (3, "", "c"), (5, "...", "c"), (6, "...", "c"), (7, "few words", "c"), (8, "few words!", "c"), (9, "few other", "c"),
            (10, long, "c"), (11, long + " more", "c"), (None, long, "c"), (12, "same row here", "c"), (12, "same row here", "c"), (None, "alone", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = D.classes(df).collect()
    assert len(got) == len(rows)
    ids = {}
    for r in got:
        ids.setdefault(r.doc_id, set()).add(r.class_id)
    assert ids[4] == ids[3] == {3} and ids[5] == ids[6] == {5} and ids[7] == ids[8] == {7} and ids[9] == {9}
    assert ids[10] == ids[11] == {10} and ids[None] == {10, None} and ids[12] == {12}
    assert sum(r.kept for r in got) == 7
    out = D.drop_near_duplicates(df)
    assert out.columns == df.columns and out.count() == 7
    assert D.classes(df.limit(0)).count() == 0


def test_words_are_the_pattern():
    rng = random.Random(5)
    signs = [chr(i) for i in range(128)] + list("KİéßÀªⅧ½漢_\x85\xa0 —́ ﻿𝟘😀") * 3 + list("abc ") * 9
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in [*texts, "".join(map(chr, range(0x300))), "a\ud800b \ud83dc"]:
        assert D.words_of(t) == D._WORD.findall(t.lower())


def test_sketch_takes_the_least_in_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 30_000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        picked = D.sketch(h)[1].reshape(D.SKETCHES, -1)
        for seed, got in zip(D._SEEDS, picked):
            x = D._mix(h ^ seed)
            assert got.tolist() == x[np.sort(np.argsort(x)[:D.PICK])].astype(np.uint32).astype(np.int32).tolist()


def boilerplate(seed, groups):
    """Pairs of texts that share a passage with all others; one word in five of the rest is changed."""
    rng = random.Random(seed)
    passage, texts = [f"p{i}" for i in range(60)], {}
    for g in range(groups):
        own = [f"g{g}w{i}" for i in range(rng.randint(90, 110))]
        texts[2 * g] = " ".join(passage + own)
        texts[2 * g + 1] = " ".join(passage + [f"x{g}y{i}" if i % 5 == 3 else w for i, w in enumerate(own)])
    return texts


@pytest.mark.parametrize("few", [False, True])
def test_large_buckets_lose_no_pair(spark, few):
    """All pairs that agree in a sketch, pass the sieve and are similar, by brute force, are in a class: also where the bucket is large
    and neither is like its centre.  With one group of copies beside a few others the pairs are taken as they are, else by rare words."""
    texts = boilerplate(11, 8 if few else 60)
    if few:
        base = [f"p{i}" for i in range(60)] + [f"c{i}" for i in range(100)]
        for i in range(120):
            texts[1000 + i] = " ".join(base[:60 + i % 90] + [f"z{i}"] + base[61 + i % 90:])
    h = D.Hasher()
    prepared = {i: D.Prepared(D.words_of(t), h) for i, t in texts.items()}
    sketches = {i: [list(map(int, x)) for x in D.sketch(p.labelled[0])] for i, p in prepared.items()}
    size = defaultdict(int)
    for keys, _ in sketches.values():
        for k in keys:
            size[k] += 1
    got = {i: r.class_id for i, r in run(spark, texts).items()}
    large = 0
    for g in range(len([i for i in texts if i < 1000]) // 2):
        a, b = 2 * g, 2 * g + 1
        common = set(sketches[a][0]) & set(sketches[b][0])
        picked = [set(sketches[i][1]) for i in (a, b)]
        if common and len(picked[0] & picked[1]) >= D.SIEVE * min(map(len, picked)):
            assert D.pair_similarity(prepared[a], prepared[b]) >= 0.8
            large += all(size[k] > D.SMALL for k in common)
            assert got[a] == got[b], g
    assert large >= (4 if few else 40)
    assert all(c // 2 == i // 2 or min(c, i) >= 1000 for i, c in got.items())


def test_large_buckets_make_few_rows(spark, monkeypatch):
    """Copies of one text, most of them just below the threshold to each other: all similar pairs of a large bucket are in a class, but no
    table holds the pairs that are not."""
    rng, texts = random.Random(21), {}
    for i in range(160):
        changed = set(rng.sample(range(200), rng.choice([20, 24, 28])))
        texts[i] = " ".join(f"n{i}x{j}" if j in changed else f"b{j}" for j in range(200))
    monkeypatch.setattr(D, "SMALL", 4)
    monkeypatch.setattr(D, "PART", 40)
    rows, write = {}, D.written

    def counted(df, name, **options):
        table = write(df, name, **options)
        rows[name] = max(rows.get(name, 0), table.count())
        return table

    monkeypatch.setattr(D, "written", counted)
    got = {i: r.class_id for i, r in run(spark, texts).items()}
    h, buckets = D.Hasher(), defaultdict(set)
    prepared = {i: D.Prepared(D.words_of(t), h) for i, t in texts.items()}
    for i, p in prepared.items():
        for k in D.sketch(p.labelled[0])[0].tolist():
            buckets[k].add(i)
    met = {(a, b) for v in buckets.values() if len(v) > D.SMALL for a in v for b in v if a < b}
    similar = [(a, b) for a, b in met if D.pair_similarity(prepared[a], prepared[b]) >= 0.8]
    assert 50 < len(similar) < 0.5 * len(met)
    assert all(got[a] == got[b] for a, b in similar) and len(set(got.values())) > 3
    assert rows["block-links"] < len(texts)
    assert max(rows.values()) <= D.SKETCHES * len(texts) < len(met)


def test_block_leaves_joined_nodes_alone(monkeypatch):
    """All similar pairs of a block are joined, by words or by distinct k-mers; nodes joined by earlier links are not aligned again."""
    import pyarrow as pa
    rng = random.Random(22)
    base, line = [f"b{i}" for i in range(80)], [f"l{i}" for i in range(12)]
    texts = [" ".join(edited(rng, base, 4)) for _ in range(30)] + [" ".join(line * n + [f"r{i}" for i in range(60)]) for n in (2, 5)] + ["", "a b"]
    n = len(texts)
    table = pa.table({"key": [7] * n, "node": list(range(n)), "label": list(range(n)), "stray": [i > 0 for i in range(n)], "keys": [[7, 9]] * n,
                      "text": texts, "left": [i > 0 for i in range(n)], "right": [True] * n})
    calls, similarity = [], D.pair_similarity
    monkeypatch.setattr(D, "pair_similarity", lambda a, b: calls.append(1) or similarity(a, b))
    links = D._block(table).to_pylist()
    assert len(links) == 30 and len(calls) < 60
    assert {x for r in links for x in (r["a"], r["b"]) if x < 30} == set(range(30)) and [30, 31] in [[r["a"], r["b"]] for r in links]
    other = table.set_column(table.column_names.index("key"), "key", pa.array([9] * n))
    assert D._block(other).num_rows == 0   # key 7 is the lesser of the two they share


def least_labels(edges):
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


def joined_rows(monkeypatch, df):
    """A list that gets the rows of every join made from now on."""
    rows, kind = [], type(df)
    join = kind.join

    def counted(self, *args, **options):
        out = join(self, *args, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    return rows


def test_components_are_those_of_the_graph(spark):
    rng = random.Random(31)
    ids = rng.sample(range(1000), 120)
    star = [(n, 5000) for n in range(2000, 2030)]
    sparse = [(rng.randrange(-400, 0), rng.randrange(-400, 0)) for _ in range(220)]
    for edges in ([], [*zip(ids, ids[1:])] + star + [(5001, 5002), (5002, 5001), (5001, 5002)] + [e for e in sparse if e[0] != e[1]]):
        rows = D.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len({r.node for r in rows}) and {r.node: r.label for r in rows} == least_labels(edges)


def test_components_read_links_of_a_group_once(spark, monkeypatch):
    """Groups of all links within, in a row of groups: links within a group are not joined again in each round."""
    rng, n, size = random.Random(32), 16, 24
    ids = rng.sample(range(10_000), n * size)
    groups = [ids[g * size:(g + 1) * size] for g in range(n)]
    edges = [(a, b) for g in groups for a in g for b in g if a < b] + [(rng.choice(g), rng.choice(h)) for g, h in zip(groups, groups[1:])]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = joined_rows(monkeypatch, df)
    assert {r.node: r.label for r in D.components(df).collect()} == least_labels(edges)
    assert sorted(rows)[-3] < len(edges) / 4   # two joins read the links
    assert sum(rows) < 4 * len(edges)


def test_links_of_the_first_pass_are_not_joined_again(spark, monkeypatch):
    """Nodes of large buckets that are met later bring a forest of the earlier classes and their own links alone."""
    rng, texts = random.Random(33), boilerplate(11, 8)
    base = [f"p{i}" for i in range(60)] + [f"c{i}" for i in range(100)]
    for i in range(200):
        texts[1000 + i] = " ".join(base[:rng.randrange(60, 150)] + [f"z{i}"] + base[61 + i % 90:])
    for i in range(60):
        changed = set(rng.sample(range(60, 160), 30))
        texts[2000 + i] = " ".join(f"y{i}x{j}" if j in changed else w for j, w in enumerate(base))
    tables, write = defaultdict(list), D.written

    def counted(df, name, **options):
        table = write(df, name, **options)
        tables[name].append(table.count())
        return table

    monkeypatch.setattr(D, "written", counted)
    run(spark, texts)
    (links,), (more,) = tables["links"], tables["block-links"]
    assert more and links > 2 * len(texts)
    assert sum(tables["edges"]) < links + 2 * len(texts)
