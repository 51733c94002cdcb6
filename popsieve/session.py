"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow.fs
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where the package is installed on the executors this changes nothing.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir); only a local session may lack it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="popsieve-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/popsieve/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder `fresh` in the place of `path`."""
    delete(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(fresh)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).rename(place, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{fresh} can't become {path}")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, for what Python workers write themselves, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else Path(path.removeprefix("file:")).absolute().as_uri())
