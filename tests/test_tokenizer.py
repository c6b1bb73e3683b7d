import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.functions.tokens import BYTE_IDS, all_special_tokens, byte_symbol_table
from tessera.operators import bpe
from tessera.operators import tokenizer as tk
from tessera.sources.tables import read_table

ODD = ["a  b\n\n c", "it's they'll we've I'm", "x y　z\u0085w", "emoji 😀😀!!", "é combining",
       "١٢٣ numerals Ⅻ", "tabs\t\tand   spaces   ", "", "   ", "end \n"]


def _lib_pieces(text):
    from tokenizers import pre_tokenizers
    return [p for p, _ in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def _as_symbols(piece):
    sym = dict(byte_symbol_table())
    return "".join(sym[b] for b in piece.encode("utf-8"))


def test_pretokenizer_matches_library(spark):
    texts = ODD + [r.text for r in read_table(spark, SF_SMALL, "conversations").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(tk.pretokenize("t").alias("p")).collect()]
    for t, g in zip(texts, got):
        assert [_as_symbols(x) for x in g] == _lib_pieces(t), t


def _library_trained(rows, vocab_size):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tr = trainers.BpeTrainer(vocab_size=vocab_size, show_progress=False, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
                             special_tokens=all_special_tokens())
    tok.train_from_iterator(rows, trainer=tr)
    model = json.loads(tok.to_str())["model"]
    return tok, [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]], model["vocab"]


def _as_strings(merges):
    strs = bpe.token_strings(bpe.merge_table(merges))
    return [(strs[r.left], strs[r.right]) for r in merges.orderBy("rank").collect()], strs


def test_bpe_training_and_encoding_match_library(spark):
    """The whole vocabulary: 6,400 ids, or until no pair is left."""
    texts = read_table(spark, SF_SMALL, "conversations").select("text")
    merges = bpe.train_bpe(tk.word_counts(texts, "text"))
    mine, strs = _as_strings(merges)
    tok, ref, vocab = _library_trained([r.text for r in texts.collect()], 6400)
    assert mine == ref and len(mine) > 4000
    # vocabulary ids agree too
    assert all(vocab[s] == i for i, s in strs.items())
    df = read_table(spark, SF_SMALL, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    df = df.unionByName(spark.createDataFrame([(10**9, "<|im_start|>user\nhi<|im_end|>\n<think>x</think>"), (10**9 + 1, "anananan " * 3 + "a" * 3000)], "k long, text string"))
    got = {r.k: list(r.ids) for r in bpe.encode_bpe(df, "text", "k", merges).collect()}
    for r in df.collect():
        assert tok.encode(r.text).ids == got.get(r.k, []), r.text


def test_bpe_rounds_under_any_bound(spark, tmp_path):
    """Few chains a round, down to one pair at a time, give the same merges; no round's table stays behind."""
    import os
    from tessera.session import ensure_checkpoint_dir
    words = ["aaaa", "aaaaaaa", "abab", "abcabc", "bcab", "xyxyx", "xyz", "abc", "bca", "cab", "ééé", "aab"]
    counts = spark.createDataFrame([(w, 3 + 5 * i % 7) for i, w in enumerate(words)], "word string, n long")
    rows = [w for i, w in enumerate(words) for _ in range(3 + 5 * i % 7)]
    _, ref, vocab = _library_trained(rows, 330)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for head, most in ((1, 1), (2, 6), (4, 50), (512, 50_000)):
        rounds = []
        mine, strs = _as_strings(bpe.train_bpe(counts, 330, head=head, most_chains=most, rounds=rounds))
        assert mine == ref and all(vocab[s] == i for i, s in strs.items()), (head, most)
        assert all(n <= max(most, 7) for _, n, _ in rounds)
    assert set(os.listdir(folder)) == before


def test_byte_ids_are_first_after_specials():
    assert min(BYTE_IDS) == 36 and max(BYTE_IDS) == 291


def test_tokenizer_job_end_to_end(spark):
    import os
    import tempfile

    from tessera.plans.tokenizer_job import evaluate, train_tokenizer
    from tessera.sources.sinks import load_tokenizer
    d = tempfile.mkdtemp(prefix="tessera-tok-", dir="/tmp")
    corpus = os.path.join(d, "corpus.jsonl")
    rows = read_table(spark, SF_SMALL, "conversations").orderBy("conv_id", "turn").collect()
    with open(corpus, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps({"conversations": [{"role": r.role, "content": r.text}]}, ensure_ascii=False) + "\n")
        f.write("{broken\n")
    merges = train_tokenizer(spark, corpus, os.path.join(d, "tok"), vocab_size=bpe.FIRST_MERGE_ID + 20)
    vocab, saved = load_tokenizer(spark, os.path.join(d, "tok"))
    assert saved.count() == 20 and vocab.count() == 36 + 256 + 20
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "lang", "text")
    ev = evaluate(docs, "text", "doc_id", merges, ["lang"]).collect()
    assert sum(r.n_rows for r in ev) == docs.count() and all(r.n_fail == 0 for r in ev)
    n_bytes = docs.select(F.sum(F.octet_length("text"))).first()[0]
    assert sum(r.n_tokens for r in ev) < n_bytes          # merges shorten the byte sequence


def test_merged_vocabulary_in_the_jobs(spark):
    """SFT and pretraining samples with trained merges: shorter, and they decode to the same texts."""
    from pyspark.sql import functions as F

    from tessera.operators import bpe, chat
    from tessera.operators import tokenizer as tk
    from tessera.plans import sft
    from tessera.plans.tokenizer_job import decode_with
    texts = ["the cat sat on the mat"] * 3 + ["the other cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id long, text string")
    merges = bpe.train_bpe(tk.word_counts(df, "text"), vocab_size=bpe.FIRST_MERGE_ID + 20)
    encode = sft.merged_encoder(merges)
    conv = df.withColumn("conversations", F.array(chat.make_message(F.lit("user"), F.col("text")), chat.make_message(F.lit("assistant"), F.col("text"))))
    for tools in (False, True):
        merged = sft.sft_samples(conv, max_len=96, with_tools=tools, encode=encode)
        plain = {r.sample_id: r for r in sft.sft_samples(conv, max_len=96, with_tools=tools).collect()}
        for r in merged.withColumn("back", decode_with(merges, "ids_full")).collect():
            assert r.back == r.prompt == plain[r.sample_id].prompt and len(r.ids_full) < len(plain[r.sample_id].ids_full)
            assert any(x != -100 for x in r.labels)
    p = sft.pretrain_samples(df, "sample_id", max_len=32, encode=encode).orderBy("sample_id").first()
    assert p.input_ids[0] == 1 and len(p.input_ids) == 32 and p.labels.count(-100) == p.input_ids.count(0) > 0
