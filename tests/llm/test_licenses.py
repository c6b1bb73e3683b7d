import random
import re
from re import _parser

import pytest

from tessera.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def base_of(text):
    words = WORD.findall((text or "").translate(UPPER))
    hits = [(i, label) for p, label in L.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    return (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None),
            ",".join(sorted({h[1] for h in hits})))


TEXTS = [None, "", "   \n", "Released under the MIT License.", "x CC BY-NC, cc by nc\ncc-by-nc 4.0 ccby nc", "cc by nc",
         "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
         "É under the MIT license é", "under the mİt license", "GNU Lesser General Public License v2.1 or later",
         "SPDX-License-Identifier: AGPL-3.0-only", "All rights reserved. Copyright (c) 2020 x", "under the mit license " * 3000,
         "word " * 5000 + "Mozilla Public License 2.0", "the licence of nothing", "\x00cc\x7fby{nc}", "Apache License Version 2 under the MIT License"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    return {r.doc_id: r for r in L.scan(df.unionAll(df.where("doc_id = 3"))).collect()}


def test_base_matches_brute_force(rows):
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(t), t


def test_method_labels_resolve(rows):
    got = {TEXTS[i]: set(filter(None, r.labels.split(","))) for i, r in rows.items()}
    assert got["GNU Lesser General Public License v2.1 or later"] == {"lgpl-2.1"}
    assert got["SPDX-License-Identifier: AGPL-3.0-only"] == {"agpl-3"}
    assert got["This work is licensed under the GNU General Public License, version 3."] == {"gpl-3"}
    assert got["Licensed under the Apache License, Version 2.0."] == {"apache-2"}
    assert got["the licence of nothing"] == set()
    assert got["All rights reserved. Copyright (c) 2020 x"] == {"proprietary", "copyright"}


def test_intervals_match_python_regex(rows):
    """Every kept interval is a match of its rule, and none of the unresolved ones is left inside a gap."""
    for i, t in enumerate(TEXTS):
        words = WORD.findall((t or "").translate(UPPER))
        line = " " + " ".join(words) + " "
        found = []
        for n, rule in enumerate(L.RULES):
            if f" {rule.keyword}" in line:
                for m in re.finditer(f" (?:{rule.pattern})(?= )", line):
                    start = line[:m.start()].count(" ")
                    found.append((start, start + m[0].count(" "), n))
        if t and len(t) < 1000:
            assert [(d.start, d.stop, d.rule) for d in rows[i].detections] == by_priority(found), t


def by_priority(found):
    """Take the first rule's interval, or the longest around it; strike out what overlaps it; go on with the rest."""
    left, kept = list(found), []
    while left:
        first = min(n for _, _, n in left)
        around = [x for x in left if any(x[0] <= y[0] and y[1] <= x[1] for y in left if y[2] == first)]
        best = min(around, key=lambda x: (x[0] - x[1], x[0], x[2]))
        kept.append(best)
        left = [x for x in left if x[1] <= best[0] or best[1] <= x[0]]
    return sorted(kept)


def test_chains_of_overlaps(spark):
    """A loser suppresses nothing: rules of any priority over stretches that overlap in chains and lie in each other."""
    import dataclasses
    rng = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    line = " ".join(words)
    for _ in range(12):
        spans = [(a, rng.randint(a + 1, min(12, a + 6))) for a in (rng.randrange(12) for _ in range(6))]
        rules = [dataclasses.replace(L.RULES[0], keyword=words[a], label=f"r{n}", pattern=" ".join(words[a:b])) for n, (a, b) in enumerate(spans)]
        got = L.scan(spark.createDataFrame([(1, line)], "doc_id long, text string"), rules=rules).first()
        want = by_priority([(a, b, n) for n, (a, b) in enumerate(spans)])
        assert [(d.start, d.stop, d.rule) for d in got.detections] == want, spans
    hi, mid, low = (dataclasses.replace(L.RULES[0], keyword=k, label=x, pattern=p) for k, x, p in (("cc", "hi", "cc dd ee"), ("bb", "mid", "bb cc"), ("aa", "low", "aa bb")))
    got = L.scan(spark.createDataFrame([(1, "aa bb cc dd ee")], "doc_id long, text string"), rules=[hi, mid, low]).first()
    assert got.labels == "hi,low"


def sample(rng, parsed):
    """A random match of a parsed pattern."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            kind, y = rng.choice(x)
            out += chr(y if str(kind) == "LITERAL" else rng.randint(*y))
        elif op == "BRANCH":
            out += sample(rng, rng.choice(x[1]))
        elif op == "SUBPATTERN":
            out += sample(rng, x[-1])
        elif op == "MAX_REPEAT":
            out += "".join(sample(rng, x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
        else:
            raise ValueError(op)
    return out


def samples(times=20):
    rng = random.Random(5)
    return [(rule, sample(rng, _parser.parse(rule.pattern))) for rule in L.RULES for _ in range(times)]


def test_every_match_holds_its_keyword():
    """Without the gate, on random matches of each pattern."""
    for rule, text in samples():
        assert re.fullmatch(rule.pattern, text)
        assert f" {rule.keyword}" in f" {text}", (rule, text)


def test_gated_names(spark):
    texts = {"Creative Commons Attribution-Non-Commercial 4.0": "cc-by-nc-4", "Creative Commons Attribution-Non Commercial-NoDerivs": "cc-by-nc-nd",
             "Creative Commons Attribution Non-Commercial Share Alike": "cc-by-nc-sa", "Creative Commons Attribution-Non-Commercial": "cc-by-nc",
             "the Internet Systems Consortium License": "isc"}
    rows = L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.labels for r in rows} == texts


def test_spelled_out_strings_stand_in_every_match():
    assert L.spelled_out("(the )?((gnu )?general public licen[cs]e( version)? v?3( 0)?)") == ["general public licen"]
    for rule, text in samples():
        assert all(x in f" {text} " for x in L.spelled_out(rule.pattern)), (rule, text)


def test_no_match_is_lost(spark):
    """Random matches of every rule, broken over lines, against all rules without any gate."""
    texts = [text.replace(" ", "\n" if n % 3 else " ") for n, (_, text) in enumerate(samples(1))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    compiled = [re.compile(f" (?:{r.pattern})(?= )") for r in L.RULES]
    for i, found in rows.select("i", L.detections(L.word_string(rows.text))).collect():
        line = " " + " ".join(WORD.findall(texts[i].translate(UPPER))) + " "
        want = {(line[:m.start()].count(" "), line[:m.end()].count(" "), n) for n, p in enumerate(compiled) for m in p.finditer(line)}
        assert {(d.start, d.stop, d.rule) for d in found} == want, line
    assert all(r.labels for r in L.scan(rows).collect())


def test_texts_without_the_word_license(spark):
    texts = {"This code is released under the GPL v3.": "gpl-3", "Distributed under the terms of the AGPL 3.0": "agpl-3", "Available under Apache 2.0": "apache-2",
             "Permission is hereby\ngranted, free of charge, to any person\nobtaining a copy": "mit", "All rights\nreserved.": "proprietary",
             "nothing of the kind": ""}
    rows = L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.labels for r in rows} == texts
    assert all((r.score > 0) == (r.labels != "") for r in rows)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hundreds_of_rules():
    assert len(L.RULES) > 300 and all(re.compile(r.pattern) for r in L.RULES)
