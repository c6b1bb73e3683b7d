import numpy as np
import pytest

from conftest import SF_CHECK
from tessera.llm import toxicity as T
from tessera.llm.common import held_out


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    return T.fit(docs, labels)


def test_char_counts_match_brute_force(spark):
    texts = ["Abc é1 x", None, "", "zzzz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    n = np.zeros(T.CELLS)
    line = "\n\n\n".join(t or "" for t in texts)
    s = [ord(c.lower()) - 96 if c.isascii() and c.isalpha() else 27 if c == "é" else 0 for c in line]
    for i in range(len(s) - 3):
        n[((s[i] * T.A + s[i + 1]) * T.A + s[i + 2]) * T.A + s[i + 3]] += 1
    assert np.allclose(T.char_model(df), T.smoothed(n.reshape((T.A,) * 4)), atol=1e-4)


def test_decode_is_the_cheapest_path():
    """Against trying every reading of short pieces."""
    import itertools
    rng = np.random.default_rng(0)
    d = T.Decoder(T.smoothed(rng.integers(0, 5, (T.A,) * 4).astype(float)).astype(np.float32))
    for piece in ("1d10t", "s-s", "i d", "aab", "$0!"):
        spaced = " " in piece
        best = None
        for path in itertools.product(*(d.options(piece, i, spaced) for i in range(len(piece)))):
            context, cost = 0, 0.0
            for out, channel in path:
                cost += channel
                if out:
                    cell = context * T.A + T._symbol(out)
                    cost, context = cost + d.costs[cell], cell % T.A ** 3
            cost += d.costs[context * T.A]
            best = cost if best is None else min(best, cost)
        got = d.decode(piece)
        assert any("".join(o for o, _ in p) == got for p in itertools.product(*(d.options(piece, i, spaced) for i in range(len(piece)))))
        costs = []
        for path in itertools.product(*(d.options(piece, i, spaced) for i in range(len(piece)))):
            if "".join(o for o, _ in path) == got:
                context, cost = 0, 0.0
                for out, channel in path:
                    cost += channel
                    if out:
                        cell = context * T.A + T._symbol(out)
                        cost, context = cost + d.costs[cell], cell % T.A ** 3
                costs.append(cost + d.costs[context * T.A])
        assert min(costs) == pytest.approx(best)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).select("score", "toxic").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert right >= 0.9 * len(rows)


def test_obfuscated_words_score_alike(model):
    s = T.Scorer(model)
    plain = s.score("the moron of")
    assert plain >= 0.5
    for x in ("m0r0n", "m o r o n", "m.o.r.o.n", "mmooorrroonnn", "MORON!!!", "m*o*r*o*n", "ｍｏｒｏｎ", "mo​ron"):
        assert s.score(f"the {x} of") >= 0.5, x
    assert s.score("the thing of and") < 0.5


def test_more_noise_scores_alike(model):
    """Doubled letters, look-alike letters and any white space between characters."""
    s = T.Scorer(model)
    for plain, forms in {"stupid": ["stuupid", "stuupid;", "sstupid"], "idiot": ["iidiot", "idіot"], "scum": ["sscumm", "ѕcum"], "trash": ["ttrash"],
                         "moron": ["mоron", "mоrоn", "m  o  r  o  n", "m\to\tr\to\tn", "m\no\nr\no\nn", "m o  r \t o n"]}.items():
        own = s.score(f"the {plain} of")
        assert own > 2 * s.score("the thing of"), plain
        for x in forms:
            assert s.score(f"the {x} of") == pytest.approx(own), x
    assert s.score("i d i o t   y o u") >= 0.5
    assert s.decoder.restore("good letters happen") == "good letters happen"
    assert "good" in s.words("good letters happen")
    for x in ("good", "letter", "happen", "a  b  c", "1  2  x"):
        assert s.score(f"the {x} of") < 0.5, x


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 200_000, "x"), (4, "1" * 50_000, "x"), (5, "moron", "x"), (5, "moron", "x"), (None, "moron", "x")]
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.score >= 0.5 for r in got) == 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert T.score(docs, T.fit(docs, labels)).first().score == 0
    none = docs.limit(0)
    assert T.score(none, T.fit(none, labels.limit(0))).count() == 0
