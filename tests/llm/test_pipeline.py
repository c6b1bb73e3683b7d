"""The stages against brute-force versions on a small fixture, and the whole run on the smallest tables."""
import os
import random

import pytest

import corpus_pipeline as P
from conftest import SF_SMALL
from tessera.llm import decontam, quality
from tessera.llm.encoding import load
from tessera.llm.queries import tokenizer_path

STOP = "the of and to in a is that for it was on"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(w for i in range(n) for w in ("".join(rng.choices("bcfghaexuz", k=7)), STOP.split()[i % 12]))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, text(i), "en", "s", "kept") for i in range(40)]
    docs += [(100 + i, text(200 + i) + " moron idiot", "en", "s", "toxic") for i in range(30)]
    docs += [(200, text(0) + " tail", "en", "s", "near"), (201, text(0), "en", "s", "near"), (202, text(1), "en", "s", "near")]
    docs += [(300, text(300) + " one two three four five six seven eight nine ten " + text(301), "en", "s", "leak")]
    docs += [(400, "too short", "en", "s", "poor"), (401, None, "en", "s", "poor"), (402, "", "en", "s", "poor"), (403, "# $ " * 100, "en", "s", "poor")]
    docs += [(500, " ".join(text(500 + k) for k in range(40)), "en", "s", "kept")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kept string").write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int(r[4] == "toxic")) for r in docs if r[4] in ("toxic", "kept")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_keeps_what_it_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {r.doc_id: r.kept for r in docs.collect()}
    for (name, stage), gone in zip(P.STAGES[:4], ("poor", "toxic", "near", "leak")):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        path = f"{os.path.dirname(sf_dir)}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left = {i: k for i, k in left.items() if k != gone}
        assert {r.doc_id: r.kept for r in docs.collect()} == left, name
    packed = P.STAGES[4][1](spark, docs, sf_dir).collect()
    library = load(tokenizer_path("byte_bpe_50k.json"))
    n = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in n} == n


def test_run_is_the_stages(spark, sf_dir):
    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == {*range(40), 500}


def test_empty_documents(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = P.run(spark, SF_SMALL).collect()
    kept = {r.doc_id for r in rows}
    good = {r.doc_id for r in quality.apply_rules(docs).where("kept").collect()}
    leaks = {r.doc_id for r in decontam.tilings(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert kept and kept <= good - leaks
