"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last keep the columns of documents, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, dedup, packing, quality, toxicity
from tessera.llm.common import scratch_path
from tessera.llm.queries import tokenizer_path
from tessera.sources.tables import read_table


def _filtered(docs: DataFrame, decide) -> DataFrame:
    """Rows of ``docs`` for which ``decide``, given a table of text alone, adds a true column ``__llm_keep``; the documents' own
    columns ride along as one struct, so no name can clash."""
    packed = docs.select(F.struct(*docs.columns).alias("__llm_row"), "text")
    return decide(packed).where("__llm_keep").select("__llm_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _filtered(docs, lambda d: quality.apply_rules(d).withColumnRenamed("kept", "__llm_keep"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  The language model is counted over the stage's documents; the classifier learns
    from the labelled ones among them."""
    model = toxicity.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: toxicity.score(d, model, out="__llm_score").withColumn("__llm_keep", F.col("__llm_score") < 0.5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least doc_id."""
    return dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item to the threshold go."""
    items = read_table(spark, sf_dir, "benchmark")
    return _filtered(docs, lambda d: decontam.with_coverage(d, items, "__llm_coverage").withColumn(
        "__llm_keep", F.col("__llm_coverage") < decontam.THRESHOLD))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents left."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the toxicity model nor sketches, tiling and packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
