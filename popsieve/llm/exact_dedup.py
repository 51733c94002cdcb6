"""Op 9. Exact dedup of texts: a two-pass Bloom filter, and of the rows only possible repeats shuffle.

Every text is read once: its case-folded (A-Z only) SHA-256 is written beside its id, and all later steps
read these narrow rows alone. Pass 1 sets, for each hash, `HASHES` cells of a Bloom filter, and keeps the cells that
at least two rows set. Building it shuffles cell numbers, HASHES of 8 bytes a row at most (summed
before they are shuffled), where grouping everything would shuffle ids and hashes of 40 bytes.
Pass 2 tests each row: if one of its
cells was set only once, no other row has its text, and it passes straight through. The rest, possible
repeats, are grouped by hash; partial sums keep a hot text to a row a task, and groups of many rows are
given back to them by a broadcast, so no task gets a hot text's rows.

The filter has 8 to 16 cells a row up to `max_bits`, so its broadcast bitmaps have a proven bound
(HASHES * max_bits / 8 bytes). Past some hundred million rows it fills, and at some thousand million nearly
every row counts as a possible repeat: then all of them are grouped. The result never
depends on the filter's size.

Null text counts as empty, and equals an empty text. Of equal texts the row with the largest id stays; a null
id is less than any other. Rows that repeat an id and text are all counted, and one stays for each such
row of the largest id. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, given_back, id_and_text

#: Cells a row sets; bits of one stored bitmap (as bitmap_bit_position deals them); the filter's bounds.
HASHES = 2
BLOCK = 32768
MIN_BITS = 1 << 20
MAX_BITS = 1 << 29


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only: the built-in lower() where the text is ASCII, else letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    """What equal texts share, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(fold_case(F.coalesce(text, F.lit(""))), 256))


def cells(digest: Column, bits: int) -> Column:
    """The cells that a hash sets, in 1..bits for the first, bits+1..2*bits for the second and so on."""
    return F.array(*(F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) + F.lit(k * bits + 1) for k in range(HASHES)))


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(MIN_BITS, 1 << math.ceil(math.log2(max(1, rows) * 8))))


def repeated_cells(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the cells that two rows or more have set; at most HASHES * bits / 8 bytes."""
    set_twice = hashes.select(F.explode(cells(F.col("digest"), bits)).alias("cell")).groupBy("cell").count().where("count > 1")
    return set_twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def _is_set(bitmap: Column, cell: Column) -> Column:
    """Whether a bitmap has the bit of the cell; no bitmap, no bit."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))


def marked(hashes: DataFrame, bits: int) -> DataFrame:
    """`hashes` with `maybe`: whether its text may occur twice. The bitmaps are bounded, so they are broadcast."""
    out = hashes
    maps = repeated_cells(hashes, bits)
    for k in range(HASHES):
        cell = F.element_at(cells(F.col("digest"), bits), k + 1)
        one = maps.where(F.col("bucket").between(k * bits // BLOCK + 1, (k + 1) * bits // BLOCK)).select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
        out = out.join(F.broadcast(one), F.bitmap_bucket_number(cell) == F.col("_bucket"), "left").withColumn(f"_in{k}", _is_set(F.col("_bitmap"), cell)).drop("_bucket", "_bitmap")
    all_set = F.lit(True)
    for k in range(HASHES):
        all_set = all_set & F.col(f"_in{k}")
    return out.withColumn("maybe", all_set).drop(*(f"_in{k}" for k in range(HASHES)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    hashes = scratch.written(id_and_text(docs, id_col, text_col).select("doc_id", text_digest(F.col("text")).alias("digest")), "hashes")
    tested = kept.written(marked(hashes, filter_bits(hashes.count(), max_bits)), "tested")
    scratch.drop()
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    again = tested.where("maybe").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("_n")).withColumn("group_size", F.col("_n"))
    grouped = given_back(again, kept.written(groups, "exact-groups"), ["digest"], kept).select("doc_id", "keep_id", "group_size", "digest")
    out = alone.unionByName(grouped)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
