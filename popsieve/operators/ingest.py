"""Normalizing molecule text: row filters, the two dedups, and the three build pipelines.

Inputs are rows (chunk_id, line_no, line). Order matters to both dedups, so they order by line_no within a chunk;
a chunk is one file, which bounds the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.delimited import Options, has_header, parse_fields, resolve, sniff_enamine, with_fields
from .chemistry import backend, with_canonical


def dedup_consecutive(rows: DataFrame, key: str, chunk: str = "chunk_id", order: str = "line_no") -> DataFrame:
    """Drop a row whose key equals that of the row before it in the chunk; null keys must be gone already."""
    before = F.lag(key).over(Window.partitionBy(chunk).orderBy(order))
    return rows.withColumn("_before", before).where(~F.col(key).eqNullSafe(F.col("_before"))).drop("_before")


def dedup_keep_first(rows: DataFrame, key: str, chunk: str = "chunk_id", order: str = "line_no") -> DataFrame:
    """Of the rows of a chunk with the same key, the first in line order.

    A grouped minimum comes before the shuffle, so a key of many rows costs a row a task.
    """
    columns = [c for c in rows.columns if c not in (chunk, key)]
    first = rows.groupBy(chunk, key).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    return first.select(*(F.col(c) if c in (chunk, key) else F.col(f"_first.{c}") for c in rows.columns))


def download_filter(lines: DataFrame) -> DataFrame:
    """chunk_id, line_no, smiles, compound_id of ZINC lines: two fields, neither empty, a valid id, not that of the
    line before it."""
    rows = lines.select("chunk_id", "line_no", text.tab_field(F.col("line"), 0).alias("smiles"), text.tab_field(F.col("line"), 1).alias("compound_id"))
    rows = rows.where("smiles != '' and compound_id != ''").withColumn("short_id", text.short_id(F.col("compound_id"))).where("short_id is not null")
    return dedup_consecutive(rows, "short_id").drop("short_id")


def remove_stereo(lines: DataFrame, make=backend) -> DataFrame:
    """chunk_id, line_no, smiles, short_id, prefixed of ZINC lines.

    SMILES over 162 bytes go first. Rows without a valid id stay, without id, and don't count as the line before;
    the others lose repeats of it. Then unparsable SMILES go, and later copies of one in its chunk.
    """
    field = text.tab_field(F.col("line"), 1)
    rows = lines.select("chunk_id", "line_no", text.tab_field(F.col("line"), 0).alias("smiles"), text.short_id(field).alias("short_id"), text.has_zinc_prefix(field).alias("prefixed"))
    rows = rows.where((F.col("smiles") != "") & text.fits(F.col("smiles")))
    rows = dedup_consecutive(rows.where("short_id is not null"), "short_id").unionByName(rows.where("short_id is null"))
    rows = with_canonical(rows, make).where(F.col("canonical").isNotNull() & text.fits(F.col("canonical")))
    return dedup_keep_first(rows.drop("smiles").withColumnRenamed("canonical", "smiles"), "smiles")


def zinc_lines(rows: DataFrame) -> DataFrame:
    """chunk_id, line_no, line: the output rows of remove_stereo."""
    return rows.select("chunk_id", "line_no", text.zinc_row(F.col("smiles"), F.col("short_id"), F.col("prefixed")).alias("line"))


def enamine(lines: DataFrame, make=backend) -> DataFrame:
    """chunk_id, line_no, smiles, compound_id of files with a header; neither cell is trimmed, ids may be empty."""
    delimiter, smiles, compound, first = _headed(lines, sniff_enamine)
    rows = with_fields(lines.where(F.col("line_no") > first), delimiter).where(F.size("fields") > max(smiles, compound))
    rows = rows.select("chunk_id", "line_no", F.get("fields", smiles).alias("smiles"), F.get("fields", compound).alias("compound_id")).where("smiles != ''")
    return with_canonical(rows, make).where("canonical is not null").select("chunk_id", "line_no", F.col("canonical").alias("smiles"), "compound_id")


def _headed(lines: DataFrame, sniff):
    """What sniff() says of the first nonblank line of a chunk's file, and that line's number."""
    row = lines.where(text.stripped(F.col("line")) != "").orderBy("line_no").select("line", "line_no").first()
    if row is None:
        raise ValueError("the file has no lines")
    return *sniff(row["line"]), row["line_no"]


def normalize_smi(lines: DataFrame, options: Options = Options(), make=backend) -> DataFrame:
    """SMILES, perhaps an |extension|, perhaps a name; a row without name gets a generated id."""
    trimmed = lines.withColumn("_line", text.stripped(F.col("line"))).where("_line != ''")
    rest = text.stripped(F.regexp_replace(F.regexp_extract("_line", r"^\S+\s+(.*)$", 1), r"^\|[^|]*\|", ""))
    rows = trimmed.select("chunk_id", "line_no", F.regexp_extract("_line", r"^(\S+)", 1).alias("smiles"), rest.alias("_name"))
    rows = with_canonical(rows, make).where("canonical is not null")
    return rows.select("chunk_id", "line_no", F.col("canonical").alias("smiles"), _named(rows, F.col("_name"), options).alias("compound_id"))


def _named(rows: DataFrame, name, options: Options):
    clean = text.sanitized_id(F.coalesce(name, F.lit("")))
    return F.when(clean != "", clean).otherwise(text.generated_id(F.col("chunk_id"), F.col("line_no"), options.prefix))


def normalize_delimited(lines: DataFrame, delimiter: str, options: Options = Options(), make=backend) -> DataFrame:
    """chunk_id, line_no, smiles, compound_id of one file's lines; short or malformed rows and empty SMILES go."""
    first = lines.where(text.stripped(F.col("line")) != "").orderBy("line_no").select("line", "line_no").first()
    if first is None:
        raise ValueError("the file has no lines")
    fields = parse_fields(first["line"].removeprefix("﻿"), delimiter) or []
    header = has_header(fields, options)
    smiles, compound = resolve(fields, header, options)
    rows = with_fields(lines.where(F.col("line_no") > first["line_no"]) if header else lines.where(text.stripped(F.col("line")) != ""), delimiter)
    name = F.lit("") if compound is None else F.get("fields", compound)
    if not header and options.compound_id.explicit and options.compound_id.index is not None and compound >= len(fields):
        raise ValueError(f"id column {compound} is out of range for a data row")
    if not header and smiles >= len(fields):
        raise ValueError(f"SMILES column {smiles} is out of range for a data row")
    rows = rows.where(F.size("fields") > max(smiles, -1 if compound is None else compound)).select("chunk_id", "line_no", text.stripped(F.get("fields", smiles)).alias("smiles"), text.stripped(name).alias("_name")).where("smiles != ''")
    rows = with_canonical(rows, make).where("canonical is not null")
    return rows.select("chunk_id", "line_no", F.col("canonical").alias("smiles"), _named(rows, F.col("_name"), options).alias("compound_id"))


def totals(before: DataFrame, written: DataFrame) -> DataFrame:
    """One row (read, kept): the totals of a download run over all chunks."""
    both = before.select(F.lit(1).cast("long").alias("read"), F.lit(0).cast("long").alias("kept")).union(written.select(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return both.agg(F.coalesce(F.sum("read"), F.lit(0)).alias("read"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))


def counters(before: DataFrame, valid: DataFrame, written: DataFrame) -> DataFrame:
    """chunk_id, read, written, skipped (invalid), duplicates (later copies)."""
    a = before.groupBy("chunk_id").agg(F.count("*").alias("read"))
    b = valid.groupBy("chunk_id").agg(F.count("*").alias("valid"))
    c = written.groupBy("chunk_id").agg(F.count("*").alias("written"))
    rows = a.join(b, "chunk_id", "left").join(c, "chunk_id", "left").fillna(0, ["valid", "written"])
    return rows.select("chunk_id", "read", "written", (F.col("read") - F.col("valid")).alias("skipped"), (F.col("valid") - F.col("written")).alias("duplicates"))
