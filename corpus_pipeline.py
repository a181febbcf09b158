"""A corpus from raw documents to packed windows, in five stages that each use one operator of ``meterloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again before the next. All
but the last return the columns of ``docs``. The result has one row per packed piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import minhash, packing, pii, rules, toxicity
from meterloom.llm.batches import BATCH_BYTES, BATCH_CONF, stored
from meterloom.llm.catalog import TOKENIZER

# Models cannot be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references."""
    return rules.judge(docs).where("kept").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of documents that are left, does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: the smallest id, a null id only if there is no other. Rows that repeat
    an id and its text are one document."""
    key = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_hash": F.xxhash64("text")}
    kept = minhash.survivors(docs).withColumnRenamed("text_hash", "_hash").select(key["_id"].alias("_id"), key["_none"].alias("_none"), "_hash")
    # The rows are dealt by these columns for the join already.
    left = docs.withColumns(key).join(kept, list(key), "left_semi")
    return left.dropDuplicates(list(key)).select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids over all documents, one row per piece."""
    return packing.pack(docs, TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with rows handed to Python in small batches. Its rows are computed after it returns, so the session keeps
    that setting."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("quality rules", bounded(quality)), ("toxicity", bounded(clean)), ("near-duplicates", bounded(distinct)), ("personal data", bounded(private)), ("packing", bounded(packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
