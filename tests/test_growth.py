"""What a step holds or repeats: bounded pieces in the Python workers, values made once a row."""
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_byte_encoder_gives_out_small_pieces():
    from tessera.operators import tokenizer as tk
    texts = ["ab<think>é" * 100, None, ""] * 1000 + ["x" * (3 << 20)]
    out = list(tk._encode_bytes_udf.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert sum(map(len, out)) == len(texts)
    assert all(len(x) <= tk.PIECE_ROWS and (len(x) == 1 or len(x.flatten()) <= tk.PIECE_BYTES) for x in out)
    got = [ids for x in out for ids in x.to_pylist()]
    assert got == [None if t is None else tk.encode_bytes_py(t).tolist() for t in texts]


def test_end_of_answer_is_looked_up_once_a_row(spark):
    from tessera.operators import sequences as sq
    d = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.when(i == 3000, 2).otherwise(7)).alias("ids"))
    d = d.withColumn("m", F.transform("ids", lambda x: F.lit(1)))
    began = time.monotonic()
    kept = d.select(F.aggregate(sq.first_eos_mask("ids", "m"), F.lit(0), lambda a, v: a + v).alias("n")).distinct().collect()
    assert [r.n for r in kept] == [3000]
    assert time.monotonic() - began < 15


def test_preference_ids_are_padded_once_a_row(spark):
    from tessera.plans import catalog
    assert "element_at(concat(" not in plan_of(catalog.QUERIES["preference_pairs"](spark, SF_SMALL))


def test_delta_split_walks_partitions_not_groups(spark):
    from tessera.plans import catalog
    plan = plan_of(catalog.QUERIES["delta_split"](spark, SF_SMALL))
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_ngram_words_are_split_once_per_table_scan(spark):
    from tessera.plans import catalog
    assert plan_of(catalog.QUERIES["distinct_ngrams"](spark, SF_SMALL)).count("split(") == 2


def test_merged_encoder_and_decoder_over_pieces(spark):
    from tessera.operators import bpe
    from tessera.plans.tokenizer_job import decode_with
    merges = spark.createDataFrame([(0, 69 + 31, 100, 292, 5)], "rank int, left int, right int, id int, count long")
    texts = ["aa aab<think>a\n é", "", None, "a < b", "<|im_start|>aaa"] * 300
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert "(?:(?!" in plan_of(d.select(bpe.encode_bpe_column("t", merges)))
    d = d.withColumn("ids", bpe.encode_bpe_column("t", merges)).withColumn("back", decode_with(merges, "ids")).orderBy("i").collect()
    assert [r.back for r in d] == [t or "" for t in texts]
    assert 292 in d[0].ids and d[0].ids == d[5].ids and d[2].ids == []
