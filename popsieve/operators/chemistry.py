"""Molecule backends: canonical SMILES without stereo, and circular fingerprints.

RDKit is used where it can be imported. The fallback is a documented subset: it removes stereo marks at text
level (not canonical) and hashes character n-grams of the SMILES into a fingerprint. It lets every
pipeline run and be tested, but its values are not those of a chemistry toolkit, and none are claimed.
"""

from __future__ import annotations

import importlib.util
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.similarity import word_names
from ..session import importable
from ..sources.native import words_of

RADIUS = 2


class Backend(Protocol):
    exact: bool

    def canonical(self, smiles: str) -> str | None: ...

    def fingerprint(self, smiles: str, bits: int) -> np.ndarray | None: ...


class TextBackend:
    """Text rules only; `exact` is False."""

    exact = False
    _TOKEN = re.compile(r"(\[[^\]\s]+\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|[0-9()=#\-+\\/:.~@?>*$])")

    def canonical(self, smiles: str) -> str | None:
        if not smiles or "".join(self._TOKEN.findall(smiles)) != smiles or smiles.count("(") != smiles.count(")"):
            return None
        bare = re.sub(r"\[([CNOPSc])@{1,2}H?\d?\]", r"\1", smiles)
        return re.sub(r"[@/\\]", "", bare)

    def fingerprint(self, smiles: str, bits: int) -> np.ndarray | None:
        if self.canonical(smiles) is None:
            return None
        tokens = self._TOKEN.findall(smiles)
        out = np.zeros(bits, np.uint8)
        for size in range(1, 2 * RADIUS + 2):
            for k in range(len(tokens) - size + 1):
                out[zlib.crc32("".join(tokens[k : k + size]).encode()) % bits] = 1
        return out


class RdkitBackend:
    exact = True

    def __init__(self):
        from rdkit import Chem, RDLogger
        from rdkit.Chem import rdFingerprintGenerator

        RDLogger.DisableLog("rdApp.*")
        self.chem, self.makers, self.maker = Chem, {}, rdFingerprintGenerator.GetMorganGenerator

    def canonical(self, smiles: str) -> str | None:
        mol = self.chem.MolFromSmiles(smiles)
        if mol is None:
            return None
        self.chem.RemoveStereochemistry(mol)
        return self.chem.MolToSmiles(mol, isomericSmiles=False)

    def fingerprint(self, smiles: str, bits: int) -> np.ndarray | None:
        mol = self.chem.MolFromSmiles(smiles)
        if mol is None:
            return None
        maker = self.makers.setdefault(bits, self.maker(radius=RADIUS, fpSize=bits))
        return maker.GetFingerprintAsNumPy(mol).astype(np.uint8)


def backend() -> Backend:
    return RdkitBackend() if importlib.util.find_spec("rdkit") else TextBackend()


def with_canonical(rows: DataFrame, make=backend, column: str = "smiles") -> DataFrame:
    """rows plus canonical (null where the SMILES can't be parsed)."""
    importable(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", canonical string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chemistry = make()
        for batch in batches:
            found = [None if s is None else chemistry.canonical(s) for s in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "canonical"])

    return rows.mapInArrow(run, schema)


def with_fingerprints(rows: DataFrame, sizes: list[int], make=backend, column: str = "smiles") -> DataFrame:
    """rows plus the words fp<bits>_w0 ... of every size; rows that can't be parsed are dropped. One parse a row."""
    importable(rows.sparkSession)
    names = [n for bits in sizes for n in word_names(bits, f"fp{bits}_w")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chemistry = make()
        for batch in batches:
            found = [[None if s is None else chemistry.fingerprint(s, bits) for bits in sizes] for s in batch.column(column).to_pylist()]
            good = [x[0] is not None for x in found]
            kept = batch.filter(pa.array(good))
            if kept.num_rows:
                words = np.concatenate([words_of(np.packbits(np.stack([x[k] for x, ok in zip(found, good, strict=True) if ok]), axis=1)) for k in range(len(sizes))], axis=1)
                yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, words.T)], [*kept.schema.names, *names])

    return rows.mapInArrow(run, schema)
