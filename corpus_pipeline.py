"""Corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, tokenisation.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder and reads it again as the next one's ``docs``.  All stages but the
last return the columns of ``documents``.

- quality_rules drops the documents that operator 7 rejects.
- minhash_near_dedup keeps the document with the least id of each near-duplicate component, and
  one row of rows that repeat an id and text; documents without words are linked to nothing and stay.
- substring_dedup cuts repeated passages out of all but the first document that holds them.
- benchmark_decontamination drops documents that hold a benchmark item.
- sentencepiece adds the ids of the text (``ids``, ``n_tokens``); decoding them gives the text back.

Rows with one id and different texts are documents of their own in the dropping and cutting stages.
Null ids stay in every stage; empty tables give empty results; further columns are carried along.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.llm import decontam, neardup, quality, spm, substrings
from longctx.llm.queries import MODEL_PATH
from longctx.operators.ordinal import ordinal_within
from longctx.session import cut_lineage, ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def _by_text(stage: Stage) -> Stage:
    """``stage`` with each (id, text) as a document of its own, if ids repeat: numbers in their order stand for the ids."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if again.isEmpty():
            return stage(spark, docs, sf_dir)
        key = ["doc_id", "_digest"]
        marked = docs.withColumn("_digest", F.coalesce(F.md5(F.encode("text", "utf-8")), F.lit("")))
        numbers = cut_lineage(ordinal_within(marked.where("doc_id is not null").select(*key).distinct(), [], key, "_number"))
        numbered = marked.join(numbers, key, "left").select(
            F.col("_number").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"], F.col("doc_id").alias("_id"))
        out = stage(spark, numbered, sf_dir)
        return out.select(*[F.col("_id").alias(c) if c == "doc_id" else c for c in docs.columns])
    return run


@_by_text
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


@_by_text
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs)


@_by_text
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spm.encode(docs, MODEL_PATH)
    return out.select("row.*", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup),
          ("substring_dedup", substring_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("sentencepiece", sentencepiece)]

#: The robust estimates and the segmentation have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
