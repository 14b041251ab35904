"""Registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.llm import (align, decontam, langid, mainhtml, nbsvm, neardup, quality, resample, sharding, spm, substrings,
                         urls, warc)
from longctx.llm.oracle import ORACLE  # noqa: F401 - registered with the queries
from longctx.session import ensure_checkpoint_dir

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", _remainder(4) == 2)
    model = langid.train(docs.where("not held_out").select("lang", "text"))
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    return langid.predict(docs, model, ["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every page url by the curated rules, else by the purity of its path template."""
    out = urls.judge_urls(_table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return out.select("row.page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, their number, and whether decoding them gives the text back."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    out = spm.encode(docs, MODEL_PATH, decode=True, keep=["doc_id", "text"])
    return out.select("row.doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids",
                      F.col("decoded").eqNullSafe(F.col("row.text")).alias("round_trip"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the similarity of the best window."""
    return decontam.contaminated(_table(spark, sf, "documents").select("doc_id", "text"),
                                 _table(spark, sf, "benchmark").select("item_id", "text"))


def op5_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    out = mainhtml.extract(_table(spark, sf, "pages").select("page_id", "url", "html"), ["page_id", "url"])
    return out.select("row.*", "text", "n_chars")


def op6_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of 50 words or more that occur in several documents, by document."""
    return substrings.repeated_passages(_table(spark, sf, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Word statistics of every document and the verdict of base rules and robust outliers."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    out = quality.judge(docs, ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "distance")


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    warc.write_archives(_table(spark, sf, "pages").select("page_id", "url", "html"), folder)
    out = warc.resolve_revisits(warc.read_archives(spark, folder))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid", "error")


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document; learned from labels whose crc32(doc_id) mod 3 is not 1."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    labels = _table(spark, sf, "labels").where(_remainder(3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = nbsvm.train(docs, labels)
    docs = docs.withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    return nbsvm.score(docs, model, ["doc_id", "held_out"]).select("row.*", "score", F.when(
        F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents; the least id of each is kept."""
    return neardup.near_duplicates(_table(spark, sf, "documents").select("doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's word n-grams; every document's weight."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    out = resample.resample(docs, _table(spark, sf, "benchmark"), ["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """24 shards of near equal bytes; equal texts stay together."""
    out = sharding.assign(_table(spark, sf, "documents").select("doc_id", "text"), 24, ["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of the byte-level and the SentencePiece tokens of every document, with corpus counts."""
    out = align.aligned(_table(spark, sf, "documents").select("doc_id", "text"), BYTE_BPE_PATH, MODEL_PATH, ["doc_id"],
                        groups="sha256")
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_url_filter, op3_sentencepiece, op4_decontamination, op5_main_text, op6_repeated_passages,
    op7_quality_rules, op8_warc, op9_quality_classifier, op10_minhash, op11_importance_resampling, op12_sharding,
    op13_token_alignment)}
