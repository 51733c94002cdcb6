"""Import and export of fingerprint files: .npy matrices of packed bytes, .refs and .frames."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import onbits_from_name, word_names
from ..session import importable


def words_of(matrix: np.ndarray) -> np.ndarray:
    """Packed bytes (rows x bytes, big-endian bits) as signed 64-bit words, padded with zeros."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return padded.view(">i8").astype(np.int64)


def bytes_of(words: np.ndarray, bits: int) -> np.ndarray:
    return np.ascontiguousarray(words, np.int64).astype(">i8").view(np.uint8).reshape(len(words), -1)[:, : bits // 8]


def read_npy(spark: SparkSession, path: str | list[str], bits: int) -> DataFrame:
    """path, position, onbits (from the name), words. Files hold at most a million rows by construction."""
    names = word_names(bits)
    importable(spark)
    files = spark.read.format("binaryFile").load(path).select("path", onbits_from_name(F.col("path")).alias("onbits"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, onbits, content in zip(*(batch.column(c).to_pylist() for c in ("path", "onbits", "content")), strict=True):
                matrix = np.load(io.BytesIO(content))
                if matrix.ndim != 2 or matrix.dtype != np.uint8 or matrix.shape[1] * 8 != bits:
                    raise ValueError(f"{name} is no matrix of {bits} bits")
                words = words_of(matrix)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(range(len(words)), pa.int64()), pa.array([onbits] * len(words), pa.int32()), *map(pa.array, words.T)], ["path", "position", "onbits", *names])

    return files.mapInArrow(run, ", ".join(["path string", "position long", "onbits int", *(f"{n} long" for n in names)]))


def npy_files(fp: DataFrame, bits: int) -> DataFrame:
    """(chunk_idx, onbits, content): a .npy file per stored part, for a binary sink of the caller's.

    A part has at most a million rows (see Database), which bounds a group.
    """
    importable(fp.sparkSession)
    names = word_names(bits)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        out = io.BytesIO()
        np.lib.format.write_array(out, np.ascontiguousarray(bytes_of(np.stack([table.column(n).to_numpy() for n in names], 1), bits)), version=(2, 0))
        return pa.table({"chunk_idx": table.column("chunk_idx")[:1], "onbits": table.column("onbits")[:1], "content": pa.array([out.getvalue()], pa.binary())})

    return fp.groupBy("chunk_idx", "onbits").applyInArrow(pack, "chunk_idx long, onbits int, content binary")


def read_refs(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, row in frame) of little-endian packed references."""
    refs = np.frombuffer(content, "<u4")
    return refs >> 19, refs & ((1 << 19) - 1)


def read_frames(content: bytes) -> np.ndarray:
    """Byte offsets of the compressed frames."""
    return np.frombuffer(content, "<u8")
