"""Corpus pipeline: toxicity, near duplicates, decontamination, PII, packing.

Every stage works on all rows that the stage before it kept. Stages one to four
return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.catalog import PII_KEY, word_tokenizer
from riskspark.llm.common import stage
from riskspark.llm.decontaminate import drop_contaminated
from riskspark.llm.packing import pack_documents
from riskspark.llm.pii import replace_pii
from riskspark.llm.simhash import keep_one
from riskspark.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score calls toxic go."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near SimHash fingerprints the one with the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; n_chars follows the text."""
    cols = docs.columns
    out = replace_pii(docs, PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(cols)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit decreasing over the token pieces of what is left."""
    return pack_documents(docs, word_tokenizer())


STAGES = [("zstd_toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("cgk_decontamination", decontamination),
          ("pii_surrogates", pii), ("best_fit_packing", packing)]

#: Trained dictionaries, fingerprint graphs, edit distances and tokenisers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
