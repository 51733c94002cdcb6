"""Helpers that every operator of this subpackage shares.

Conventions: an operator takes a DataFrame plus the names of its id and text columns, selects only
the columns it needs (so other columns, whatever their names, never clash) and treats null text as
the empty text unless its docstring says otherwise.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Arrow batches handed to Python stay below this many bytes (documents of any length fit in memory).
ARROW_BYTES = 8 << 20

#: Rows from which a group is hot; hot groups that are broadcast at most, and the salts used beyond.
HOT, BROADCAST_GROUPS, SALTS = 64, 500_000, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local session may lack it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="popsieve-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables in the shared folder that an operator needs for a while.

    An operator that ends with a table of its own drops the rest, so that what it leaves there is what its
    result reads. Nothing that is still to be computed may read a dropped table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/popsieve/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove all tables written so far."""
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def given_back(rows: DataFrame, groups: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """`rows` joined to their group's columns; groups are unique by `keys`, which are never null, and `_n` says how many rows each has.

    No task gets a large group's rows: groups of over HOT rows are few next to the rows, and are broadcast. Where
    even they are over BROADCAST_GROUPS, rows are salted and every group goes to each salt.
    """
    hot = scratch.written(groups.where(F.col("_n") > HOT), "hot-groups")
    count = hot.count()
    if count > BROADCAST_GROUPS:
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt", "_n")
    if not count:
        return rows.join(groups, keys).drop("_n")
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col("_n") <= HOT), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(few).drop("_n")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): null text becomes the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, whatever the length of the documents."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def giving_back(out: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of `out`; after the last, what they took and freed goes back to the system. Python workers
    outlive their task, and memory that they hold on to is memory all later stages lack."""
    yield from out
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over `df` by run(batches), whose memory goes back when a task is over."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: giving_back(run(batches)), schema)


def map_texts(df: DataFrame, make, schema: str) -> DataFrame:
    """map_arrow over `df`; make() is called once a task and gives a function batch -> table/batch."""

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return map_arrow(df, run, schema)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(name).to_pylist()

