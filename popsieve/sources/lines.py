"""Text lines in file order, from plain, gzip, BGZF, bzip2 and zstd files."""

from __future__ import annotations

import gzip
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line
from ..session import importable

#: Lines that the decompressor of .bgzf files hands on at once.
BATCH = 10_000


def read_lines(spark: SparkSession, path: str | list[str], numbered: bool = True) -> DataFrame:
    """path, line, and line_no from 1 in file order (blank lines count).

    Spark's text source decodes .gz, .bz2 and .zst by suffix; .bgzf goes through read_bgzf. Splits of a file
    come in any order, so lines are numbered by (block start, place in the split). Numbering sorts within
    each file; leave it out where order doesn't matter.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), clean_line(F.col("value")).alias("line"))
    if not numbered:
        return text.drop("_block")
    text = text.withColumn("_at", F.monotonically_increasing_id())
    return text.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("_block", "_at"))).select("path", "line", F.col("line_no").cast("long").alias("line_no"))


def read_bgzf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same of .bgzf files, which Spark would read as raw bytes: blocked gzip, decoded a line at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    importable(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines, count = [], 0
                with gzip.open(pa.BufferReader(content)) as stream:
                    for raw in stream:
                        lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                        if len(lines) == BATCH:
                            yield _batch(name, lines, count)
                            count, lines = count + len(lines), []
                if lines:
                    yield _batch(name, lines, count)

    return files.mapInArrow(decode, "path string, line string, line_no long")


def _batch(name: str, lines: list[str], before: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines, pa.string()), pa.array(range(before + 1, before + len(lines) + 1), pa.int64())], ["path", "line", "line_no"])


def read_any(spark: SparkSession, paths: list[str], numbered: bool = True) -> DataFrame:
    """Lines of files of every supported compression."""
    blocked = [p for p in paths if p.lower().endswith(".bgzf")]
    others = [p for p in paths if p not in blocked]
    parts = ([read_lines(spark, others, numbered)] if others else []) + ([read_bgzf(spark, blocked)] if blocked else [])
    if not parts:
        raise ValueError("no files given")
    return parts[0] if len(parts) == 1 else parts[0].select("path", "line", *(["line_no"] if numbered else [])).unionByName(parts[1].select("path", "line", *(["line_no"] if numbered else [])))


def output_path(rel_path: str, abs_path: str = "", out_dir: str = "") -> str:
    """The name of a normalized file: .gz, .bgzf and .bz2 give way to .zst, .zst stays, others get .zst; an absolute
    path gives its file name, and so does abs_path where rel_path is empty. An output that is the input is an error."""
    name = rel_path or abs_path.rsplit("/", 1)[-1]
    name = name.rsplit("/", 1)[-1] if name.startswith("/") else name
    if name.lower().endswith((".gz", ".bgzf", ".bz2")):
        name = name.rsplit(".", 1)[0] + ".zst"
    elif not name.lower().endswith(".zst"):
        name += ".zst"
    if abs_path and out_dir and posixpath.normpath(f"{out_dir}/{name}") == posixpath.normpath(abs_path):
        raise ValueError(f"{abs_path} would be overwritten")
    return name


def write_lines(rows: DataFrame, column: Column, path: str, compression: str = "gzip") -> None:
    """Lines in files of Spark's naming, by the codecs that Spark writes text with; zstd, names and order by chunk: chunks.write_chunks."""
    rows.select(column.alias("value")).write.mode("overwrite").option("compression", compression).text(path)
