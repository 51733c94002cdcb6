"""Searching a database with a stream of queries.

Each micro-batch of packed queries (query_idx, q-words) meets the stored database in one scan, and the database
shuffles only if a batch is too large to broadcast; hits are appended to a sink. Stateless, so a retried batch writes its own files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.similarity import word_names
from ..operators.database import Database
from ..operators.search import get_sim_compounds_of_rows


def threshold_hits(db: Database, queries: DataFrame, lower: float, upper: float) -> DataFrame:
    """chunk_idx, query_idx, position, score for queries (query_idx, q0 ...) in a DataFrame of any size."""
    words = [F.col(q).alias(w) for q, w in zip(word_names(db.bits, "q"), word_names(db.bits), strict=True)]
    hits = get_sim_compounds_of_rows(db, queries.select(F.col("query_idx").alias("query_id"), *words), lower, upper)
    return hits.select("chunk_idx", F.col("query_id").alias("query_idx"), "position", "score")


def start(db: Database, stream: DataFrame, lower: float, upper: float, path: str, checkpoint: str) -> StreamingQuery:
    """Append the hits of every micro-batch under path/batch=<n>; a batch that runs again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # it is counted before it is searched
        threshold_hits(db, batch, lower, upper).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
