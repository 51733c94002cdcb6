"""Delimited molecule files: a strict dialect, and the rules that pick their columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable

FORMATS = {"auto": "auto", "smi": "smi", "smiles": "smi", "cxsmiles": "smi", "csxmiles": "smi", "csv": "csv", "tsv": "tsv", "tab": "tsv"}
HEADERS = {"auto": None, "yes": True, "true": True, "1": True, "no": False, "false": False, "0": False}


def parse_fields(line: str, delimiter: str) -> list[str] | None:
    """The fields of one line, or None where it is malformed.

    A quote opens only at the start of a field, "" inside quotes is a quote, text after a closing quote is
    appended; a quote after text, or one that isn't closed, is malformed. Fields don't span lines.
    """
    fields, field, quoted, touched, at = [], [], False, False, 0
    while at < len(line):
        c = line[at]
        if quoted:
            if c == '"' and line[at + 1 : at + 2] == '"':
                field.append('"')
                at += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == delimiter:
            fields.append("".join(field))
            field, touched = [], False
        elif c == '"':
            if touched or field:
                return None
            quoted = touched = True
        else:
            field.append(c)
        at += 1
    if quoted:
        return None
    return [*fields, "".join(field)]


def with_fields(rows: DataFrame, delimiter: str, column: str = "line") -> DataFrame:
    """rows plus fields array<string>, null where the line is malformed."""
    importable(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", fields array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if line is None else parse_fields(line, delimiter) for line in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "fields"])

    return rows.mapInArrow(run, schema)


def guess_format(path: str) -> str:
    """csv or tsv by suffix (under .gz, .bz2 or .zst), else smi; .csv.bgzf is smi."""
    name = path.lower()
    for suffix in (".gz", ".bz2", ".zst"):
        if name.endswith(suffix):
            name = name[: -len(suffix)]
            break
    return "csv" if name.endswith(".csv") else "tsv" if name.endswith((".tsv", ".tab")) else "smi"


def guess_format_column(path: Column) -> Column:
    name = F.regexp_replace(F.lower(path), r"\.(gz|bz2|zst)$", "")
    return F.when(name.endswith(".csv"), "csv").when(name.rlike(r"\.(tsv|tab)$"), "tsv").otherwise("smi")


def find_column(header: list[str], name: str) -> int:
    """The first column of that name, in any case and trimmed; -1 if none."""
    wanted = name.strip().lower()
    return next((k for k, field in enumerate(header) if field.strip().lower() == wanted), -1)


@dataclass(frozen=True)
class Selector:
    """A column by name or index, or none; explicit if the caller gave it."""

    name: str | None = None
    index: int | None = None
    explicit: bool = False

    @classmethod
    def parse(cls, text: str, may_disable: bool = True) -> Selector:
        text = text.strip()
        if text.lower() in ("none", "-"):
            if not may_disable:
                raise ValueError("the SMILES column can't be disabled")
            return cls(explicit=True)
        return cls(index=int(text), explicit=True) if text.isdigit() else cls(name=text, explicit=True)

    @property
    def disabled(self) -> bool:
        return self.name is None and self.index is None


@dataclass(frozen=True)
class Options:
    format: str = "auto"
    header: bool | None = None
    smiles: Selector = Selector(name="smiles")
    compound_id: Selector = Selector(name="id")
    prefix: str = "mol"

    @classmethod
    def parse(cls, format: str = "auto", header: str = "auto", smiles: str | None = None, compound_id: str | None = None, prefix: str = "mol") -> Options:
        if format.lower() not in FORMATS:
            raise ValueError(f"unknown format {format!r}")
        if header.lower() not in HEADERS:
            raise ValueError(f"unknown header option {header!r}")
        return cls(FORMATS[format.lower()], HEADERS[header.lower()], Selector.parse(smiles, False) if smiles else cls.smiles, Selector.parse(compound_id) if compound_id else cls.compound_id, prefix)


def has_header(first: list[str], options: Options) -> bool:
    """Whether the first line is a header, where the caller doesn't say."""
    if options.header is not None:
        return options.header
    if options.smiles.index is not None:
        return False
    if find_column(first, options.smiles.name) < 0:
        return False
    chosen = options.compound_id
    return chosen.disabled or chosen.index is not None or not chosen.explicit or find_column(first, chosen.name) >= 0


def resolve(first: list[str], header: bool, options: Options) -> tuple[int, int | None]:
    """(SMILES column, id column or None) of a file with that first line."""

    def column(chosen: Selector, what: str, default: int | None, needed: bool) -> int | None:
        if chosen.disabled:
            return None
        if chosen.index is not None:
            if header and chosen.index >= len(first):
                raise ValueError(f"{what} column {chosen.index} is out of range")
            return chosen.index
        if not header:
            if chosen.explicit:
                raise ValueError(f"{what} column {chosen.name!r} needs a header")
            return default
        at = find_column(first, chosen.name)
        if at < 0 and needed:
            raise ValueError(f"no {what} column {chosen.name!r}")
        return at if at >= 0 else None

    smiles = column(options.smiles, "SMILES", 0, True)
    return smiles, column(options.compound_id, "id", 1 if len(first) > 1 else None, options.compound_id.explicit)


def sniff_enamine(first: str) -> tuple[str, int, int]:
    """(delimiter, SMILES column, id column) of a header line: comma, then TAB; a byte-order mark is dropped."""
    line = first.removeprefix("﻿")
    for delimiter in (",", "\t"):
        header = parse_fields(line, delimiter)
        if header is not None:
            smiles, compound = find_column(header, "smiles"), find_column(header, "id")
            if smiles >= 0 and compound >= 0:
                return delimiter, smiles, compound
    raise ValueError("no header with smiles and id")
