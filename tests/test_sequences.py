import random
import re

from pyspark.sql import functions as F

from tessera.operators.sequences import (align_logprobs, assistant_spans, first_eos_mask, left_truncate_pad,
                                         pad_right, span_labels, tail, wrap_truncate)
from tessera.operators.tokenizer import encode_bytes, encode_bytes_native, encode_bytes_py, decode_bytes

BOS = encode_bytes_py("<|im_start|>assistant\n").tolist()
EOS = encode_bytes_py("<|im_end|>\n").tolist()


def labels_by_regex(ids, limit):
    """Labels from a regular expression over one character per id: what stands after a start mark up to and with the next
    end mark (or the end) is kept; only places below the limit."""
    chars = lambda xs: "".join(chr(0x100 + x) for x in xs)
    text = chars(ids)
    out = [-100] * len(ids)
    for m in re.finditer(f"{re.escape(chars(BOS))}((?s:.*?)(?:{re.escape(chars(EOS))}|$))", text):
        for j in range(m.start(1), min(m.end(1), limit)):
            out[j] = ids[j]
    return out


def test_span_labels_match_the_definition(spark):
    rng = random.Random(7)
    rows = []
    for k in range(300):
        ids = []
        for _ in range(rng.randint(0, 6)):
            r = rng.random()
            ids += BOS if r < 0.3 else EOS if r < 0.5 else [rng.choice([1, 2, 100, 234, 50])] * rng.randint(1, 4)
        rows.append((k, ids, rng.randint(1, 40)))
    df = spark.createDataFrame(rows, "k long, ids array<int>, L int")
    got = {}
    for L in sorted({r[2] for r in rows}):
        sub = df.filter(F.col("L") == L).withColumn("p", pad_right("ids", L))
        sub = sub.withColumn("sp", assistant_spans("p", BOS, EOS)).withColumn("lab", span_labels("p", "sp", len(EOS), L))
        got.update({r.k: (r.p, r.lab) for r in sub.collect()})
    for k, ids, L in rows:
        p, lab = got[k]
        assert lab == labels_by_regex(list(p), L), (ids, L)


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    r = df.select(tail("a", 3).alias("t"), tail("a", 10).alias("t2"), wrap_truncate("a", 4).alias("w"),
                  left_truncate_pad("a", 7)[0].alias("l"), left_truncate_pad("a", 7)[1].alias("m"),
                  align_logprobs(F.transform("a", lambda x: x.cast("double")), 3).alias("al"),
                  align_logprobs(F.transform("a", lambda x: x.cast("double")), 7).alias("al2")).collect()
    assert r[0].t == [3, 4, 5] and r[0].t2 == [1, 2, 3, 4, 5] and r[0].w == [1, 1, 2, 2]
    assert r[0].l == [0, 0, 1, 2, 3, 4, 5] and r[0].m == [0, 0, 1, 1, 1, 1, 1]
    assert r[0].al == [3.0, 4.0, 5.0] and r[0].al2 == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert r[1].t == [] and r[1].w == [1, 2] and r[1].al == [0.0, 0.0, 0.0]


def test_first_eos_mask(spark):
    df = spark.createDataFrame([([5, 2, 7, 2], [1, 1, 1, 1]), ([5, 6], [1, 0]), ([2, 2], [0, 1])], "i array<int>, m array<int>")
    assert [r.x for r in df.select(first_eos_mask("i", "m").alias("x")).collect()] == [[1, 1, 0, 0], [1, 0], [0, 1]]


def test_byte_encoding_roundtrip_and_native_parity(spark):
    texts = ["", "héllo\n", "a中<think>b</think>\n\n", "<|im_start|>x<|im_end|>", "emoji 😀 and   nbsp", "<<|im_end|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select("t", encode_bytes("t").alias("a"), encode_bytes_native("t").alias("b")).collect()
    for row in r:
        assert list(row.a) == list(row.b) == encode_bytes_py(row.t).tolist()
    back = df.select("t", decode_bytes(encode_bytes("t"), skip_special=False).alias("d")).collect()
    assert all(x.t == x.d for x in back)
    assert encode_bytes_py("</think>\n\n").tolist() == [26, 234, 234]
    assert encode_bytes_py("!A").tolist() == [36, 68]


def test_byte_ids_match_public_tokenizer_alphabet():
    from tokenizers import pre_tokenizers

    from tessera.functions.tokens import BYTE_IDS, byte_symbol_table
    alpha = sorted(pre_tokenizers.ByteLevel.alphabet())
    sym = dict(byte_symbol_table())
    assert sorted(sym.values()) == alpha
    assert [BYTE_IDS[b] for b in range(256)] == [36 + alpha.index(sym[b]) for b in range(256)]
