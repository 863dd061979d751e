"""Corpus preparation: STAGES applied to documents, each stage written as Parquet and read again by the next.

Quality rules drop documents, lines that ten documents share go, one document of each group of near copies stays,
sources are mixed to their targets (a document comes once per copy that the mix takes), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, lines, minhash, mixing, rules
from twinsift.llm.queries import quality_weights, tokenizer_spec
from twinsift.llm.scratch import NULL_ID, Scratch

#: Up to so many ids are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a key of their own; of each group of near copies the row with the least id stays."""
    scratch = Scratch(spark)
    keyed = scratch.write(docs.select(F.struct("*").alias("_d"), F.monotonically_increasing_id().alias("_own")))
    groups = minhash.near_duplicates(keyed.select(F.col("_own").alias("doc_id"), "_d.text"), percent=80)
    ids = keyed.select("_own", F.coalesce(F.col("_d.doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"))
    of = groups.join(ids, F.col("doc_id") == F.col("_own")).groupBy("component_id")
    kept = scratch.write(of.agg(F.min(F.struct("_id", "_own")).alias("k")).select("k._own"))
    held = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    return keyed.join(held, "_own", "left_semi").select("_d.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a key of their own here too, so that rows which share an id, or have none, are mixed one by one."""
    keyed = Scratch(spark).write(docs.select(F.struct("*").alias("_d"), F.monotonically_increasing_id().alias("_own")))
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = keyed.select("_own", "_d.doc_id", "_d.source", "_d.text")
    return mixing.take_rows(keyed, mixing.mix(rows, weights, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, row="_own").withColumnRenamed("_own", "row"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_documents(docs, tokenizer_spec())


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix), ("bpe", encode)]
#: Components and tokens are beyond SQL; tests hold each stage against a plain version on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents under ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
