"""Token counts, packing and the id files against the library and brute force."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing, rans, token_counts
from tessera.llm.encoding import ByteEncoder, WordEncoder, load, u32
from tessera.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a  b", "\n\n\nx", "x \n y", "don't they'll", "<|endoftext|> a <|endoftext|>", "é ́ 　x", "word " * 6000, "x" * 30000,
         "same text", "same text", "tab\tand\x1cmore \x85z", "<|startoftext|>Hi THERE"]


def crc(ids):
    return zlib.crc32(u32(ids))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(11, "same text", "clash", 1), (None, "no id", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length int")


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", ByteEncoder), ("word_bpe_49k.json", WordEncoder)])
def test_encoders_match_the_library(name, kind):
    path = tokenizer_path(name)
    library, ours = load(path), kind(path, u32, b"".join)
    rng = random.Random(7)
    odd = ["Grüße,", "naïve...", "É.", "x!?", "ÀÖØöøÿ", "don't.", "a×b", "ß", "IJ", "É", "fiancé\nfoo.", "a.b", "Word\nWord, \nx"] + ["".join(rng.choice("ab .,\n\t'é1!<| \x1c　") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for t in odd + [t for t in TEXTS if t is not None]:
        assert b"".join(ours.parts(t)) == u32(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_arrays_match_the_library():
    import pyarrow as pa
    path = tokenizer_path("word_bpe_49k.json")
    library, ours = load(path), WordEncoder(path, u32, b"".join)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab .,\n\t'é1!<| \x1c　") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for t in TEXTS if t is not None]
    for part in (texts, ["", " "], []):
        ids, sizes = ours.arrays(pa.array(part, pa.string()), "<u4")
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_segments_end_with_documents(spark, monkeypatch):
    """Small segments: every cut falls between documents and nothing is lost."""
    monkeypatch.setattr(rans, "SEGMENT", 40)
    df = spark.createDataFrame([(i, "word " * (i % 23)) for i in range(200)], "doc_id long, text string")
    run = rans._write_part(tokenizer_path("word_bpe_49k.json"), 2, True)
    import pyarrow as pa
    from pyspark import TaskContext
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    rows = df.orderBy("doc_id").toArrow().to_batches()
    out = pa.Table.from_batches(list(run(iter(rows)))).to_pylist()
    assert [d for r in out for d in r["doc_ids"]] == list(range(200)) and [r["segment"] for r in out] == list(range(len(out)))
    for r in out:
        assert sum(r["lengths"]) == len(rans.decode(r["payload"])) and (sum(r["lengths"]) <= 40 or len(r["lengths"]) == 1)
    assert [n for r in out for n in r["lengths"]] == [i % 23 + 1 for i in range(200)]


def test_counts(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    library = load(path)
    rows = token_counts.count_tokens(docs, path).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_two_tiers_match_the_library():
    """Any table gives the library's counts: empty, all pre-tokens, some of them."""
    import pyarrow as pa
    path = tokenizer_path("byte_bpe_50k.json")
    library = load(path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab .,\n\t'é1!<| \x1c　") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for t in TEXTS if t is not None]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    words = sorted({w for t in texts for w in t.replace("\n", " \n").split(" ")[1:]})
    for table in ([], words, words[::3]):
        counter = token_counts.Counter(path, token_counts.frequent_lengths(table, path))
        assert counter.count(pa.array(texts, pa.string())).tolist() == want
        assert counter.count(pa.array([], pa.string())).tolist() == []
        assert counter.count(pa.array(["", " ", "x"], pa.string())).tolist() == [
            len(library.encode(t, add_special_tokens=False).ids) for t in ("", " ", "x")]


def test_frequent_words_are_found_whatever_the_parts(spark):
    rng = random.Random(4)
    texts = ["x " + " ".join(rng.choice(["hot", "warm", "warm", f"w{rng.randint(0, 5000)}"]) for _ in range(200)) for _ in range(120)]
    counts = defaultdict(int)
    for t in texts:
        for w in t.split(" ")[1:]:
            counts[w] += 1
    total, keep = sum(counts.values()), 40
    must = {w for w, n in counts.items() if n > total / keep}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {"hot", "warm"} <= must
    for parts in (1, 3, 17):
        got = token_counts.frequent_words(df.repartition(parts), keep=keep)
        assert must <= set(got) and len(got) <= keep and set(got) <= set(counts)
    assert token_counts.frequent_words(df.limit(0), keep=keep) == []


def test_packing(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    library = load(path)
    packed = packing.pack(docs, path)
    rows = packed.collect()
    ids = {(r.doc_id, r.text): [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.select("doc_id", "text").collect()}
    expected = []
    for doc in docs.select("doc_id", "text").collect():
        own = ids[doc.doc_id, doc.text]
        first = (len(own) - 1) % 2048 + 1
        cuts = [0, *range(first, len(own) + 1, 2048)]
        expected += [(doc.doc_id, k, a, b - a, crc(own[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    assert max(r.length for r in rows) <= 2048
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(docs, packed, path).collect()}
    assert made.keys() == by.keys()
    for r in rows:
        assert crc(made[r.sequence_id][r.offset:r.offset + r.length]) == r.ids_crc32


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity, shape in ((64, 40), (2048, 700), (10, 4)):
        lengths = np.clip(rng.gamma(2, shape / 2, 5000).astype(int), 1, capacity)
        hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
        for groups in (3, 50, capacity):
            plan = packing.plan_packing(hist, capacity, (groups,))
            used, ranks = defaultdict(int), defaultdict(int)
            taken = defaultdict(list)
            for length, lo, hi, per, base, offset in plan.rows:
                assert lo == ranks[length] and (hi - lo) % per == 0
                ranks[length] = hi
                for k in range((hi - lo) // per):
                    used[base + k] += per * length
                    taken[base + k].append((offset, per * length))
            assert dict(ranks) == hist and len(used) == plan.sequences and max(used.values()) <= capacity
            for parts in taken.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
        best = packing.plan_packing(hist, capacity).sequences
        assert best <= 1.02 * -(-int(lengths.sum()) // capacity) + 1
    assert packing.plan_packing({}).sequences == 0


def test_id_files(spark, docs):
    path = tokenizer_path("word_bpe_49k.json")
    library = load(path)
    rows = rans.round_trip(docs, path).collect()
    assert len(rows) == len(TEXTS) + 2
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([r.doc_id for r in rows], key=lambda d: (d is not None, d or 0))
    at = 0
    want = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        own = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        want[d.doc_id].append((len(own), crc(own)))
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_segments_round_trip_and_notice_damage():
    rng = np.random.default_rng(0)
    for n in (1, 31, 33, 8192, 32769, 200_000):
        for ids in (np.minimum(rng.zipf(1.3, n), 49407), np.full(n, 7), rng.integers(0, 49408, n)):
            payload = rans.encode(ids.astype(np.uint32))
            assert np.array_equal(rans.decode(payload), ids)
    for at in (0, 30, len(payload) // 2, len(payload) - 50):
        broken = bytearray(payload)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            rans.decode(bytes(broken))
    with pytest.raises(ValueError):
        rans.decode(payload[:-400])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    assert token_counts.count_tokens(none, path).count() == 0
    assert packing.pack(none, path).count() == 0
    assert rans.round_trip(none, tokenizer_path("word_bpe_49k.json")).count() == 0
