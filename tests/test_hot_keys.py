"""Operators whose one key may span many tasks: pieces of a sequence (W2), ranks of a clip (A15), open groups of a scan."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.scan import sorted_group_scan
from tessera.operators import advantages, audio


def token_rows(lengths, seed=5, gaps=()):
    rng = np.random.default_rng(seed)
    rows = []
    for gen, n in enumerate(lengths):
        for pos in range(n):
            if not any(a <= pos < b for g, a, b in gaps if g == gen):
                rows.append((gen % 2, gen, pos, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.8), 2 ** 60 + pos))
    return rows


def backward(rows, gamma, lam):
    want = {}
    after = {}
    for p, g, pos, v, r, m, _ in sorted(rows, key=lambda x: (x[1], -x[2])):
        nv, na = after.get(g, (0.0, 0.0))
        adv = r + gamma * nv - v * m + gamma * lam * na
        want[g, pos] = adv, adv + v * m
        after[g] = v * m, adv
    return want


@pytest.mark.parametrize("piece", [1, 4, 7, 4096])
def test_sequences_in_pieces(spark, piece):
    rows = token_rows([1, 3, 4, 5, 8, 29, 64], gaps=[(5, 8, 17), (6, 0, 9)])
    df = spark.createDataFrame(rows, "prompt_id long, gen_id long, pos int, v double, reward double, mask int, tag long").repartition(5)
    for gamma, lam in ((1.0, 0.95), (0.9, 1.0)):
        got = advantages.gae(df, gamma=gamma, lam=lam, piece=piece).collect()
        want = backward(rows, gamma, lam)
        assert len(got) == len(rows) == len(want)
        for r in got:
            assert r.tag == 2 ** 60 + r.pos
            assert (r.advantage, r.ret) == pytest.approx(want[r.gen_id, r.pos], abs=1e-9)


def test_no_tokens(spark):
    df = spark.createDataFrame([], "prompt_id long, gen_id long, pos int, v double, reward double")
    assert advantages.gae(df).collect() == []


def test_open_group_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(k, i) for k, n in ((1, 20), (2, 1), (3, 2), (4, 11)) for i in range(n)], "k long, i long")

        def total(pdf, bounds):
            return pd.DataFrame({"k": pdf["k"].iloc[bounds[:-1]].to_numpy(), "i": np.add.reduceat(pdf["i"].to_numpy(), bounds[:-1])})
        got = sorted_group_scan(df, ["k"], ["i"], total, df.schema, 1).collect()
        assert sorted(map(tuple, got)) == [(1, 190), (2, 0), (3, 1), (4, 55)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(3)
    values = {0: rng.normal(size=3000), 1: np.round(rng.normal(size=57), 1), 2: np.array([4.0]), 3: np.array([1.0, 2.0])}
    rows = [(k, i, float(x)) for k, xs in values.items() for i, x in enumerate(xs)] + [(1, 999, None), (9, 0, None)]
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(7)
    shares = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in audio.ranked_quantiles(df, "k", "x", shares, ["i"]).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        assert [got[k][s] for s in shares] == pytest.approx([np.quantile(xs, p) for p in shares.values()], abs=1e-12)


def test_signal_noise_and_silence(spark):
    n, rate = 64, 32
    rows = spark.range(1500).select("id", audio.augment_signal(F.array_repeat(F.lit(0.5), n), "id", rate=rate).alias("a")).collect()
    noisy, hushed = 0, 0
    for r in rows:
        a = np.array(r.a)
        assert len(a) == n and np.abs(a).max() <= 1
        zeros = np.flatnonzero(a == 0)
        if len(zeros):
            hushed += 1
            assert len(zeros) <= rate // 4 and (np.diff(zeros) == 1).all()
        elif len(set(np.round(a[8:-8], 12))) > 3:
            noisy += 1
            assert a[8:-8].std() < 0.02
    assert abs(hushed / len(rows) - 0.2) < 0.04 and abs(noisy / len(rows) - 0.24) < 0.05
    short = spark.range(300).select(audio.augment_signal(F.array_repeat(F.lit(0.5), rate), "id", rate=rate).alias("a")).collect()
    assert all(x != 0 for r in short for x in r.a)      # no more than a second: never silent


def test_keyed_normals(spark):
    x = [r.x for r in spark.range(20000).select(audio.keyed_normal("id", "t").alias("x")).collect()]
    assert abs(np.mean(x)) < 0.03 and abs(np.std(x) - 1) < 0.03 and not any(map(math.isnan, x))
