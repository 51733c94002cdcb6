"""Op 2. Packing by concatenate-and-cut.

Pass 1 encodes every document once and writes its ids (two bytes each) with the partition that wrote it,
the row's place there and the ids before it in that partition. Prefix sums over the partitions' totals,
a row a partition, then give every partition its global offset. Pass 2 reads the ids again and cuts
them where the global offset is a multiple of the window; a document that crosses a border leaves one
piece on each side, and so does a partition. All sequences but the last are full, so at most
window - 1 places are padded in all. Sequences are padded to the window, except that a last one whose
length is a power of two stays as it is.

The totals that reach the driver, and the offsets that are broadcast, are a row a scan partition: 100 TB in partitions
of 128 MB make under a million of 16 bytes. Which document goes first follows from how Spark deals files to partitions, so
two runs over other files of the same rows may cut elsewhere.

Null text counts as empty: its end id alone. Other columns are not read. Every id lies in exactly one piece. Repeated rows are packed
as often as they occur. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunker
from .common import documents, id_and_text, map_arrow, strings, written

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
END_ID = 1
WINDOW = 2048
#: Chunks whose ids a Python worker remembers; workers outlive the stage, so this is memory all later stages lack.
CHUNKS_KEPT = 200_000
_ENCODERS: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(path: str):
    """text -> ids as little-endian unsigned 16-bit bytes, equal to those of the tokenizers library.

    The file's vocabulary is run by tiktoken, which gives the same ids without the library's cost of an
    Encoding a call (the tests hold the two against each other, and so does the check below).
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        vocab, letters = one.get_vocab(with_added_tokens=False), byte_letters()
        if one.token_to_id(SPECIAL) != SPECIAL_ID or max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path} is no vocabulary of 16-bit ids with {SPECIAL}")
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocab.items() if token != SPECIAL}
        fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for text in ("Hello, world's  12 été\n\n x", "日本 \t\U0001f642a", "".join(map(chr, range(1, 700)))):
            if fast(text) != one.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path} is not encoded alike by both libraries")
        chunker = Chunker(lambda text: array("H", fast(text)).tobytes(), b"", limit=CHUNKS_KEPT, many=True)
        special = array("H", [SPECIAL_ID]).tobytes()
        # the library takes the special string out of a text before it cuts the rest
        _ENCODERS[path] = lambda text: special.join(map(chunker, text.split(SPECIAL))) if SPECIAL in text else chunker(text)
    return _ENCODERS[path]


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Pass 1: doc_id, ids (with the end id), n_ids, part, place, before (ids before it in its part)."""
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches):
        encode, part, place, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = [encode(text) + end for text in strings(batch)]
            sizes = [len(x) // 2 for x in ids]
            starts = [*accumulate(sizes, initial=before)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(range(place, place + len(ids)), pa.int64()), pa.array(starts[:-1], pa.int64())],
                ["doc_id", "ids", "n_ids", "part", "place", "before"],
            )
            place, before = place + len(ids), starts[-1]

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids binary, n_ids long, part long, place long, before long")


def cut(rows: DataFrame, window: int) -> DataFrame:
    """Pass 2: pieces of rows (doc_id, ids, offset); offset is the row's first id among all ids."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids, offset in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "offset")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    at = offset + start
                    length = min(n - start, window - at % window)
                    out.append((doc_id, start, length, zlib.crc32(wide[start : start + length]), n, at // window, at % window))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], NAMES)

    return map_arrow(rows, run, ", ".join(f"`{name}` long" for name in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, pad_to.

    pad_to is the padded length of the piece's sequence.
    """
    table = written(encoded(docs, id_col, text_col, path or public_tokenizers.path(TOKENIZER)), "packed-ids")
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each partition, not document
    parts = sorted((row["part"], row["n"]) for row in totals)
    offsets = dict(zip((part for part, _ in parts), accumulate((n for _, n in parts), initial=0), strict=False))
    total = sum(n for _, n in parts)
    firsts = table.sparkSession.createDataFrame([*offsets.items()] or [(0, 0)], "part long, first long")
    rows = table.join(F.broadcast(firsts), "part").select("doc_id", "ids", (F.col("first") + F.col("before")).alias("offset"))
    tail = total % window
    last = tail if tail and not tail & (tail - 1) else window
    return cut(rows, window).withColumn("pad_to", F.when(F.col("sequence_id") == total // window, F.lit(last)).otherwise(F.lit(window)).cast("long"))


def op2_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
