"""Declared input schemas (never inferred)."""

from pyspark.sql import types as T

S = T.StringType()

MESSAGE = T.StructType([
    T.StructField("role", S), T.StructField("content", S), T.StructField("reasoning_content", S),
    T.StructField("tools", S), T.StructField("tool_calls", S),
])
CONVERSATION = T.ArrayType(MESSAGE)

PRETRAIN = T.StructType([T.StructField("text", S)])
SFT = T.StructType([T.StructField("conversations", CONVERSATION)])
PREFERENCE = T.StructType([T.StructField("chosen", CONVERSATION), T.StructField("rejected", CONVERSATION)])
RLAIF = T.StructType([T.StructField("conversations", CONVERSATION)])
AGENT = T.StructType([T.StructField("conversations", CONVERSATION), T.StructField("gt", T.ArrayType(S))])
#: Vision messages may carry the functions a sample offers.
VISION_CONVERSATION = T.ArrayType(T.StructType([*MESSAGE.fields, T.StructField("functions", S)]))
TOOL_CALL = T.StructType([T.StructField("name", S), T.StructField("arguments", S)])
AUDIO_CHUNK = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("prob", T.DoubleType()),
])
