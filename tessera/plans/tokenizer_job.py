"""The tokenizer job: corpus -> pre-tokens -> word counts -> BPE merges -> saved tokenizer -> evaluation.

S6 -> T2 -> T4 (distributed) -> T5 -> S11 -> T6 / T7 / T8 / T9.  Only the merge table (bounded by the
vocabulary size) is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.tokens import ADDED_TOKENS, SPECIAL_TOKENS
from tessera.operators import bpe
from tessera.operators import tokenizer as tk
from tessera.sources.jsonl import scan_tokenizer_corpus
from tessera.sources.sinks import save_tokenizer


def vocab_frame(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """(id, token, special) for added tokens, byte symbols and merged tokens."""
    strs = bpe.token_strings(bpe.merge_table(merges))
    rows = [(i, t, t in SPECIAL_TOKENS) for i, t in enumerate(ADDED_TOKENS)] + \
        [(i, s, False) for i, s in sorted(strs.items())]
    return spark.createDataFrame(rows, "id int, token string, special boolean")


def train_tokenizer(spark: SparkSession, corpus_path: str, out_path: str | None = None, vocab_size: int = 6400,
                    max_lines: int | None = None) -> DataFrame:
    """Train on a JSONL conversation corpus (``max_lines=None``: every line) and optionally save; returns
    the merges."""
    texts = scan_tokenizer_corpus(spark, corpus_path, max_lines=max_lines)
    merges = bpe.train_bpe(tk.word_counts(texts, "text"), vocab_size=vocab_size)
    if out_path:
        save_tokenizer(vocab_frame(spark, merges), merges, out_path)
    return merges


def decode_with(merges: DataFrame, ids_col: str, skip_special: bool = False):
    """T7 for a merged vocabulary: id -> bytes table broadcast (bounded by the vocabulary size)."""
    table = bpe.token_bytes_table(bpe.merge_table(merges))
    spark = merges.sparkSession
    added = {i: t.encode("utf-8") for i, t in enumerate(ADDED_TOKENS)
             if not (skip_special and t in SPECIAL_TOKENS)}
    bc = spark.sparkContext.broadcast({**table, **added})

    @F.arrow_udf(T.StringType())
    def dec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = bc.value
        by_id = [m.get(i, b"") for i in range(max(m) + 1)] + [b""]   # the last for any other id
        for batch in batches:
            for at, n in tk.row_pieces(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False) * 4):
                out = []
                for xs in batch.slice(at, n):
                    if xs.is_valid:
                        ids = xs.values.to_numpy(zero_copy_only=False)
                        ids = np.where((ids >= 0) & (ids < len(by_id)), ids, -1)
                        out.append(b"".join(map(by_id.__getitem__, ids.tolist())).decode("utf-8", errors="replace"))
                    else:
                        out.append(None)
                yield pa.array(out, pa.string())
            if not len(batch):
                yield pa.array([], pa.string())

    return dec(F.col(ids_col))


def evaluate(df: DataFrame, text: str, key: str, merges: DataFrame, by: list[str]) -> DataFrame:
    """T8 + T9 per group: rows, mean chars/token, round-trip failures."""
    j = df.withColumn("ids", bpe.encode_bpe_column(text, merges))
    j = j.withColumn("back", decode_with(merges, "ids"))
    ratio = F.when(F.size("ids") > 0, F.length(text) / F.size("ids"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                              F.sum(F.size("ids")).cast("long").alias("n_tokens"),
                              F.avg(ratio).alias("chars_per_token"),
                              F.sum((F.col("back") != F.col(text)).cast("long")).cast("long").alias("n_fail"))
