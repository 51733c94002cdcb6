"""Small tables that steer a build: chunk tables, unfinished-chunk lists, download scripts."""

from __future__ import annotations

import shlex
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

U32 = (1 << 32) - 1
CHUNK_TABLE = "chunk_id long, abs_path string, rel_path string"


def parse_chunk_table(lines: list[str]) -> list[tuple[int, str, str]]:
    """(chunk_id, abs_path, rel_path) rows; only the first two commas divide a line.

    Blank lines are skipped; the first other line is a header if it has `chunk_id` in any case. A row without an id
    or an absolute path is skipped. An id that isn't a number of 32 bits, or a table without rows, is an error.
    """
    out, first = [], True
    for line in lines:
        if not line.strip():
            continue
        if first and "chunk_id" in line.lower():
            first = False
            continue
        first = False
        fields = [part.strip() for part in line.split(",", 2)] + ["", ""]
        if not fields[0] or not fields[1]:
            continue
        if not fields[0].isdigit() or int(fields[0]) > U32:
            raise ValueError(f"bad chunk id: {fields[0]!r}")
        out.append((int(fields[0]), fields[1], fields[2]))
    if not out:
        raise ValueError("the chunk table has no rows")
    return out


def read_chunk_table(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    """A row per file of the build, so the table is small and checked on the driver; with must_exist, so are its files."""
    rows = parse_chunk_table([row.value for row in spark.read.text(path, wholetext=False).collect()])
    if must_exist:
        for _, name, _ in rows:
            place = spark._jvm.org.apache.hadoop.fs.Path(name)
            if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                raise FileNotFoundError(name)
    return spark.createDataFrame(rows, CHUNK_TABLE)


def write_chunk_table(table: DataFrame, path: str) -> None:
    table.select("chunk_id", "abs_path", "rel_path").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parse_unfinished(lines: list[str]) -> list[int]:
    """One chunk id a line; # starts a comment."""
    out = []
    for line in lines:
        text = line.split("#", 1)[0].strip()
        if text:
            if not text.isdigit() or int(text) > U32:
                raise ValueError(f"bad chunk id: {text!r}")
            out.append(int(text))
    return out


def resume(chunks: DataFrame, unfinished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks to redo, listed ids that the table lacks) by a semi- and an anti-join on chunk_id."""
    listed = unfinished.select("chunk_id").distinct()
    return chunks.join(listed, "chunk_id", "left_semi"), listed.join(chunks, "chunk_id", "left_anti")


def existing(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """The chunk table of the outputs that exist; an empty one is an error."""
    out = chunks.join(written.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if not out.limit(1).count():
        raise ValueError("no output exists")
    return out


def parse_download_line(line: str) -> tuple[str, str] | None:
    """(url, output path) of one curl command; None for blanks and comments; anything else is an error."""
    if not line.strip() or line.lstrip().startswith("#"):
        return None
    words = shlex.split(line)
    if not words or words[0].rsplit("/", 1)[-1] != "curl":
        raise ValueError("not a curl command")
    url, output, at = None, None, 1
    while at < len(words):
        word = words[at]
        if word in ("-o", "--output"):
            at += 1
            output = words[at] if at < len(words) else None
        elif word.startswith("-o") and len(word) > 2:
            output = word[2:]
        elif url is None and word.startswith(("http://", "https://")):
            url = word
        at += 1
    if not url or not output:
        raise ValueError("a curl command needs an output path and a URL")
    return url, output


def parse_download_script(lines: list[str]) -> list[tuple[int, str, str, str]]:
    """(chunk_id, url, output_path, base_name without its last suffix); ids count commands from 0. One bad line fails the script."""
    found = [x for x in map(parse_download_line, lines) if x]
    return [(k, url, output, PurePosixPath(output).stem) for k, (url, output) in enumerate(found)]


def download(jobs: DataFrame, fetch: Callable[[str, str], str]) -> DataFrame:
    """jobs (chunk_id, url, output_path): adds status, one of ok, not_found, failed, as fetch(url, path) tells.

    fetch is the caller's: it raises FileNotFoundError where there is nothing at the URL.
    """
    importable(jobs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = []
            for url, path in zip(batch.column("url").to_pylist(), batch.column("output_path").to_pylist(), strict=True):
                try:
                    fetch(url, path)
                    status.append("ok")
                except FileNotFoundError:
                    status.append("not_found")
                except Exception:
                    status.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(status)], ["chunk_id", "status"])

    return jobs.select(F.col("chunk_id").cast("long").alias("chunk_id"), "url", "output_path").mapInArrow(run, "chunk_id long, status string")
