"""Special tokens and the byte-level symbol alphabet.

Fixed values (must equal the reference tokenizer's, in this order): the 21 special
tokens, the 6 tool/think tokens, then ``<|buffer1|>``.. to fill 36 slots.  Ids are
positions in that list.  Byte symbols follow (ids 36..291), then BPE merges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
SPECIAL_TOKENS = [
    "<|endoftext|>", "<|im_start|>", "<|im_end|>",
    "<|object_ref_start|>", "<|object_ref_end|>", "<|box_start|>", "<|box_end|>", "<|quad_start|>", "<|quad_end|>",
    "<|vision_start|>", "<|vision_end|>", "<|vision_pad|>", "<|image_pad|>", "<|video_pad|>",
    "<|audio_start|>", "<|audio_end|>", "<|audio_pad|>", "<tts_pad>", "<tts_text_bos>", "<tts_text_eod>",
    "<tts_text_bos_single>",
]
TOOL_THINK_TOKENS = ["<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>", "<think>", "</think>"]
N_SPECIAL = 36
ROLE_TOKENS = {
    "bos_token": "<|im_start|>", "eos_token": "<|im_end|>", "pad_token": "<|endoftext|>", "unk_token": "<|endoftext|>",
    "image_token": "<|image_pad|>", "audio_token": "<|audio_pad|>", "video_token": "<|video_pad|>",
    "vision_bos_token": "<|vision_start|>", "vision_eos_token": "<|vision_end|>",
    "audio_bos_token": "<|audio_start|>", "audio_eos_token": "<|audio_end|>",
}
# -------------------------------------------------------------------------------


def all_special_tokens(n: int = N_SPECIAL) -> list[str]:
    base = SPECIAL_TOKENS + TOOL_THINK_TOKENS
    return base + [f"<|buffer{i}|>" for i in range(1, n - len(base) + 1)]


ADDED_TOKENS = all_special_tokens()
TOKEN_ID = {t: i for i, t in enumerate(ADDED_TOKENS)}
PAD_ID = TOKEN_ID["<|endoftext|>"]
BOS_ID = TOKEN_ID["<|im_start|>"]
EOS_ID = TOKEN_ID["<|im_end|>"]
IMAGE_PAD_ID = TOKEN_ID["<|image_pad|>"]
AUDIO_PAD_ID = TOKEN_ID["<|audio_pad|>"]
THINK_ID = TOKEN_ID["<think>"]
THINK_END_ID = TOKEN_ID["</think>"]
IGNORE_INDEX = -100


def _printable(b: int) -> bool:
    return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255


def byte_symbol_table() -> list[tuple[int, str]]:
    """(byte, symbol) for the 256 byte-level symbols, GPT-2 style remapping (rule-built)."""
    out, extra = [], 0
    for b in range(256):
        if _printable(b):
            out.append((b, chr(b)))
        else:
            out.append((b, chr(256 + extra)))
            extra += 1
    return out


def byte_token_ids(first_id: int = N_SPECIAL) -> list[int]:
    """Token id of each byte value when symbols are sorted by code point after the specials."""
    syms = byte_symbol_table()
    order = sorted(range(256), key=lambda b: ord(syms[b][1]))
    ids = [0] * 256
    for rank, b in enumerate(order):
        ids[b] = first_id + rank
    return ids


BYTE_IDS = byte_token_ids()
ID_TO_BYTE = {tid: b for b, tid in enumerate(BYTE_IDS)}


def byte_id_expr(b: Column) -> Column:
    """Byte value (0..255) -> byte-symbol token id, as arithmetic (no lookup table)."""
    return (F.when(b <= 32, 224 + b)
            .when(b <= 126, 3 + b)
            .when(b <= 160, 130 + b)
            .when(b <= 172, b - 31)
            .when(b == 173, F.lit(291))
            .otherwise(b - 32)).cast("int")


def byte_id_sql(b: str) -> str:
    return (f"(CASE WHEN {b} <= 32 THEN 224 + {b} WHEN {b} <= 126 THEN 3 + {b} WHEN {b} <= 160 THEN 130 + {b} "
            f"WHEN {b} <= 172 THEN {b} - 31 WHEN {b} = 173 THEN 291 ELSE {b} - 32 END)")


def id_byte_expr(t: Column) -> Column:
    """Inverse of ``byte_id_expr`` for the ids of byte symbols."""
    return (F.when(t <= 129, t - 3).when(t <= 141, t + 31).when(t <= 223, t + 32).when(t <= 256, t - 224)
            .when(t <= 290, t - 130).otherwise(F.lit(173))).cast("int")
