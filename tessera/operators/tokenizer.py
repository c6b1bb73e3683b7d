"""Tokenizer jobs (T1-T10) as Spark plans.

Byte-level vocabulary: 36 added tokens, then the 256 byte symbols (ids 36..291), then merges.
``encode_bytes`` is the exact encoder for the byte vocabulary (no merges), an Arrow-batched table lookup;
``encode_bytes_native`` is the same in built-in expressions.  With merges (``train_bpe``) texts are pre-tokenized
in the JVM and their words encoded in place through a bounded cache (``bpe.encode_bpe_column``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.tokens import (
    ADDED_TOKENS, BYTE_IDS, SPECIAL_TOKENS, TOKEN_ID, byte_id_expr, byte_symbol_table, id_byte_expr,
)

# Library-default byte-level pre-tokenizer split, in Java regex syntax.
PRETOKENIZE_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _hex(s: str) -> str:
    return s.encode("utf-8").hex().upper()


_BYTE_LUT = np.array(BYTE_IDS, dtype=np.int32)
_ADDED_SPLIT = re.compile("(" + "|".join(re.escape(t) for t in ADDED_TOKENS) + ")")


def encode_bytes_py(s: str) -> np.ndarray:
    """Byte-vocabulary encoding of one string: added tokens first, then one id per UTF-8 byte."""
    if "<" not in s:
        return _BYTE_LUT[np.frombuffer(s.encode("utf-8"), dtype=np.uint8)]
    parts = []
    for k, piece in enumerate(_ADDED_SPLIT.split(s)):
        if k % 2:
            parts.append(np.array([TOKEN_ID[piece]], dtype=np.int32))
        elif piece:
            parts.append(_BYTE_LUT[np.frombuffer(piece.encode("utf-8"), dtype=np.uint8)])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


#: Rows and UTF-8 bytes of text that a Python worker encodes or decodes at a time: an Arrow batch of texts holds up to 64 MB, and its ids
#: would take several times as much.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def row_pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive pieces of a batch, each of at most ``PIECE_ROWS`` rows and, unless it is one row, ``PIECE_BYTES``."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))))
        yield at, upto - at
        at = upto


def id_lists(ids: list[np.ndarray], nulls: np.ndarray):
    """Arrow array of the id arrays of some rows."""
    import pyarrow as pa
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32, copy=False) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(nulls))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _encode_bytes_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import pyarrow.compute as pc
    for batch in batches:
        for at, n in row_pieces(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)):
            piece = batch.slice(at, n)
            yield id_lists([encode_bytes_py(s or "") for s in piece.to_pylist()], piece.is_null().to_numpy(zero_copy_only=False))
        if not len(batch):
            yield id_lists([], np.zeros(0, bool))


def encode_bytes(text) -> Column:
    """T6 over the byte vocabulary (no merges), Arrow-batched: a 256-entry lookup over each text's
    UTF-8 bytes in numpy.  Measured ~3x faster per core than the native form below."""
    return _encode_bytes_udf(F.col(text) if isinstance(text, str) else text)


def encode_bytes_native(text) -> Column:
    """The same encoder as native expressions: the UTF-8 bytes viewed as Latin-1 characters, cut into
    added tokens and runs, one id per character by arithmetic."""
    text = F.col(text) if isinstance(text, str) else text
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    pat = "(" + "|".join(re.escape(t) for t in ADDED_TOKENS) + "|[^<]+|<)"
    pieces = F.regexp_extract_all(latin, F.lit(pat), 1)
    kv = []
    for t in ADDED_TOKENS:
        kv += [F.lit(t), F.lit(TOKEN_ID[t])]
    added = F.create_map(*kv)

    def piece_ids(p):
        is_added = (F.length(p) > 1) & p.startswith("<")
        return F.when(is_added, F.array(F.element_at(added, p).cast("int"))).otherwise(
            F.transform(F.split(p, ""), lambda ch: byte_id_expr(F.ascii(ch))))

    return F.flatten(F.transform(pieces, piece_ids))


def byte_token_count(text) -> Column:
    """Number of ids of the byte vocabulary without making them: UTF-8 bytes, each added token counted once."""
    text = F.col(text) if isinstance(text, str) else text
    added = F.regexp_extract_all(text, F.lit("(" + "|".join(re.escape(t) for t in ADDED_TOKENS) + ")"), 1)
    excess = F.aggregate(added, F.lit(0), lambda n, t: n + F.octet_length(t) - 1)
    return F.octet_length(text) - F.when(F.contains(text, F.lit("<")), excess).otherwise(0)


def decode_bytes(ids, skip_special: bool = True) -> Column:
    """T7 over the byte vocabulary: ids -> bytes -> text; invalid UTF-8 becomes U+FFFD."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    first = min(BYTE_IDS)
    added = F.array(*[F.lit("" if skip_special and t in SPECIAL_TOKENS else _hex(t)) for t in ADDED_TOKENS])   # by id
    hexs = F.array_join(F.transform(ids, lambda x: F.when(x >= first + 256, F.lit(""))
                                    .when(x >= first, F.lpad(F.hex(id_byte_expr(x)), 2, "0"))
                                    .otherwise(F.coalesce(F.get(added, x), F.lit("")))), "")
    return F.make_valid_utf8(F.unhex(hexs).cast("string"))


def special_token_table(spark: SparkSession, n: int = 36) -> DataFrame:
    """(id, token, special) for the added tokens; ``special`` only for the 21 core tokens."""
    from tessera.functions.tokens import all_special_tokens
    rows = [(i, t, t in SPECIAL_TOKENS) for i, t in enumerate(all_special_tokens(n))]
    return spark.createDataFrame(rows, "id int, token string, special boolean")


def pretokenize(text) -> Column:
    """Byte-level pre-tokenizer pieces (library-default split, no prefix space)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(PRETOKENIZE_PATTERN), 0)


def byte_symbols(word) -> Column:
    """A word's UTF-8 bytes as byte-symbol token ids (the alphabet is always complete)."""
    word = F.col(word) if isinstance(word, str) else word
    return encode_bytes_native(word)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """T4: frequency of each pre-token over a corpus (partial + final hash aggregation)."""
    return (texts.select(F.explode(pretokenize(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def compression_ratio(df: DataFrame, text_col: str, n_col: str, by: list[str]) -> DataFrame:
    """Mean over rows of chars per token, per group; rows without tokens don't count."""
    n = F.col(n_col)
    return df.groupBy(*by).agg(F.avg(F.when(n > 0, F.length(text_col) / n)).alias("chars_per_token"))


def token_length_stats(df: DataFrame, n_col: str, by: list[str], max_len: int, reserve: int = 0, share: float = 0.95) -> DataFrame:
    """Rows, tokens, longest, the exact ``share`` quantile of the lengths, and the share that does not fit in
    ``max_len - reserve``."""
    n = F.col(n_col)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(n).alias("n_tokens"), F.max(n).alias("max_tokens"),
        F.percentile(n, share).alias("quantile_tokens"), F.avg((n + reserve >= max_len).cast("double")).alias("truncated_share"))
