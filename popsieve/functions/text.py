"""Column expressions on lines, ids and cells of molecule text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest SMILES, and the bytes of a short id.
MAX_SMILES, MAX_ID = 162, 12


def clean_line(line: Column) -> Column:
    """Without trailing carriage returns and line feeds."""
    return F.regexp_replace(line, r"[\r\n]+$", "")


def tab_field(line: Column, k: int) -> Column:
    """The k-th TAB field from 0, or null."""
    return F.get(F.split(line, "\t", -1), k)


def short_id(compound_id: Column) -> Column:
    """The id without a ZINC prefix in any case; null unless 1 to 12 bytes are left."""
    short = F.regexp_replace(compound_id, r"^(?i)zinc", "")
    return F.when(F.octet_length(short).between(1, MAX_ID), short)


def has_zinc_prefix(compound_id: Column) -> Column:
    return F.coalesce(compound_id.rlike(r"^(?i)zinc"), F.lit(False))


def zinc_row(smiles: Column, short: Column, prefixed: Column) -> Column:
    """smiles, or smiles TAB id; the prefix is written in capitals where the input had one."""
    return F.when(short.isNull(), smiles).otherwise(F.concat(smiles, F.lit("\t"), F.when(prefixed, F.lit("ZINC")).otherwise(F.lit("")), short))


def fits(smiles: Column) -> Column:
    return F.octet_length(smiles) <= MAX_SMILES


def sanitized(text: Column) -> Column:
    """TAB, CR and LF become blanks: one cell of a TSV file."""
    return F.translate(text, "\t\r\n", "   ")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def sanitized_id(text: Column) -> Column:
    return sanitized(stripped(text))


def generated_id(chunk_id: Column, line_no: Column, prefix: str = "mol") -> Column:
    """<prefix>_<chunk>_<line>; lines count from 1, blanks and headers included."""
    return F.concat_ws("_", F.lit(prefix), chunk_id.cast("string"), line_no.cast("string"))
