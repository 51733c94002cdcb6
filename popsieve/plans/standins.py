"""Fingerprint sources over the driver's tables.

basket: a customer's bits are its part keys modulo 128; its chunk is the nation, its payload name and segment.
signs: the sign bits of 64-dimensional embeddings; the chunk is the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import pack_bits, word_names
from ..operators.database import Database


def basket(spark: SparkSession, sf_dir: str, bits: int = 128) -> DataFrame:
    """chunk_id, line_no (the customer key), words, smiles (name), compound_id (segment)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % bits).cast("int").alias("bit"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    words = []
    for k, name in enumerate(word_names(bits)):
        inside = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - F.col("bit") % 64)
        words.append(F.bit_or(F.when(F.col("bit").between(64 * k, 64 * k + 63), inside).otherwise(F.lit(0).cast("long"))).alias(name))
    fp = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(*words)
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return fp.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("chunk_id"), F.col("c_custkey").alias("line_no"), *word_names(bits), F.col("c_name").alias("smiles"), F.col("c_mktsegment").alias("compound_id"))


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, line_no (the vector id), w0."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return rows.select(F.col("label").cast("long").alias("chunk_id"), F.col("vec_id").alias("line_no"), *(w.alias(n) for w, n in zip(pack_bits(bits, 64), word_names(64), strict=True)))


def vectors(rows: DataFrame, bits: int, wanted: list[int]) -> list[list[int]]:
    """The unpacked 0/1 vectors of a few rows (by line_no): the queries of a search."""
    names = word_names(bits)
    found = {r["line_no"]: r for r in rows.where(F.col("line_no").isin(wanted)).select("line_no", *names).collect()}
    return [[(found[k][n] >> (63 - i)) & 1 for n in names for i in range(64)][:bits] for k in wanted if k in found]


def basket_db(spark: SparkSession, sf_dir: str) -> Database:
    return Database.build(basket(spark, sf_dir), 128)
