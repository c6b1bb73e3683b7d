"""Exact duplicates against a dictionary of normalised texts, for any number of counters."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.llm import exact_dedup as E
from tessera.llm.queries import QUERIES


def by_hand(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the number of kept rows by digest."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
    keep = {d: min(ids, key=lambda i: (i is None, i)) for d, ids in groups.items()}
    return Counter((i, keep[d], len(ids), d) for d, ids in groups.items() for i in ids), keep


def check(out, rows):
    want, keep = by_hand(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert {r.text_sha256: r.doc_id for r in kept} == keep and len(kept) == len(keep)


ROWS = ([(i, f"text {i % 7}", "x") for i in range(60)] + [(1000 + i, "hot  text\n" if i % 2 else "hot text ", "y") for i in range(60)]
        + [(500, None, "n"), (501, "", "n"), (502, " ", "n"), (503, "\t\n", "n"), (504, " ", "n"), (None, "text 3", "n"), (None, "alone", "n"), (None, "alone", "n"),
           (7, "text 0", "x"), (0, "text 0", "x"), (0, "text 0", "x"), (600, "w " * 200_000, "long"), (601, "w  " * 200_000, "long")])


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_any_number_of_counters(spark, counters):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(5)
    check(E.classes(docs, counters=counters).collect(), [r[:2] for r in ROWS])
    left = E.drop_duplicates(docs, counters=counters)
    assert left.columns == docs.columns
    got, (_, keep) = left.collect(), by_hand([r[:2] for r in ROWS])
    assert Counter(r.doc_id for r in got) == Counter(keep.values())
    assert all((r.doc_id, r.text, r.keep_id) in ROWS for r in got)


def test_summaries_hold_every_frequent_digest(spark):
    rng = random.Random(2)
    values = [f"h{rng.randrange(5)}" if rng.random() < 0.5 else f"r{k}" for k in range(4000)]
    rng.shuffle(values)
    digests = spark.createDataFrame([(v.encode(),) for v in values], "digest binary").repartition(6)
    true = Counter(values)
    for most in (3, 10, 40):
        got = {bytes(r.digest).decode() for r in E.heavy_hitters(digests, most).collect()}
        assert len(got) <= most and {v for v, n in true.items() if n > len(values) / (most + 1)} <= got
        for r in E.summaries(digests, most).groupBy("digest").agg(F.sum("n").alias("n")).collect():
            n = true[bytes(r.digest).decode()]
            assert n - len(values) / (most + 1) <= r.n <= n


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.classes(docs).collect() == E.drop_duplicates(docs).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(QUERIES["op13_exact_dedup"](spark, SF_SMALL).collect(), rows)
