"""A corpus pipeline of five stages over `documents`, each of which calls one operator of popsieve.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the
shared folder and gives them, read again, to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popsieve.llm import exact_dedup, langid, minhash, packing, pii
from popsieve.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null text or no letter); the others keep their row, whatever their score."""
    model = langid.train(docs)
    found = langid.predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("doc_id", "text", "lang", "source", "n_chars")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; an id may stand for several texts, so rows go by id and text."""
    gone = exact_dedup.exact_groups(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (exact_dedup.text_digest(F.col("text")) == F.col("_digest"))
    return _without(docs, gone, same)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    gone = minhash.near_groups(docs).where("not kept").select(F.col("doc_id").alias("_id"))
    return _without(docs, gone, F.col("doc_id") == F.col("_id"))


def _without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """`docs` without the rows that are the same as one of `gone`, which is broadcast if it is small."""
    gone = written(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(few, same, "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    found = pii.find_pii(docs, keep=("text", "lang", "source", "n_chars"))
    text = pii.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select("doc_id", "text", "lang", "source", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: Language ID and the tokenizer can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
