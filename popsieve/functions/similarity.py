"""Similarity of packed bit vectors as built-in column expressions.

A fingerprint of n bits is ceil(n / 64) LONG columns w0, w1 ...; bit i is bit 63 - i % 64 of word i // 64, and
a last word is padded with zeros. Everything here compiles into whole-stage code: no Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A reference packs its row (13-bit frame and 19-bit row) in one 32-bit number.
ROW_BITS = 19
MAX_DENOMINATOR = 1_000_000


def word_names(bits: int, prefix: str = "w") -> list[str]:
    if bits <= 0 or bits % 8:
        raise ValueError(f"a fingerprint has a positive multiple of 8 bits, not {bits}")
    return [f"{prefix}{k}" for k in range((bits + 63) // 64)]


def fingerprint_sizes(text: str) -> list[int]:
    """Sizes from a comma-separated list: trimmed, without repeats, ascending."""
    sizes = sorted({int(part.strip()) for part in text.split(",") if part.strip()})
    if not sizes:
        raise ValueError("no fingerprint size given")
    for size in sizes:
        word_names(size)
    return sizes


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Bits set in both."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseAND(y))
    return total.cast("long")


def intersection_of_arrays(a: Column, b: Column) -> Column:
    """The same for array<long> words, where the size isn't known beforehand."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def ones(words: Sequence[Column]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.bit_count(word)
    return total.cast("int")


def union(inter: Column, ones_a: Column, ones_q: Column) -> Column:
    return (ones_a + ones_q - inter).cast("long")


def tanimoto(inter: Column, denominator: Column) -> Column:
    """A single-precision score; two empty vectors are alike."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(inter.cast("double") / denominator).cast("float")


def centi_score(inter: Column, denominator: Column) -> Column:
    """Per cent, halves rounded up, in integers; two empty vectors score 100."""
    return F.when(denominator == 0, F.lit(100).cast("long")).otherwise(F.call_function("div", 200 * inter + denominator, 2 * denominator)).cast("int")


def half_score(inter, denominator) -> np.ndarray:
    """IEEE half-precision scores (round to even) of arrays, on the driver: Spark has no half type."""
    inter, denominator = np.asarray(inter, np.float32), np.asarray(denominator, np.float32)
    return np.where(denominator > 0, inter / np.where(denominator > 0, denominator, 1), 1).astype(np.float16)


def rational(bound: float) -> Fraction:
    """A bound as the exact fraction of its decimal text, clamped to 0..1."""
    return Fraction(str(float(min(1.0, max(0.0, bound))))).limit_denominator(MAX_DENOMINATOR)


def common(lower: float, upper: float) -> tuple[int, int, int]:
    """(numerator of lower, numerator of upper, denominator)."""
    low, high = rational(lower), rational(upper)
    den = low.denominator * high.denominator // np.gcd(low.denominator, high.denominator)
    return int(low * den), int(high * den), int(den)


def within(inter: Column, ones_a: Column, ones_q: Column, lower: float, upper: float) -> Column:
    """lower <= i / (a + q - i) <= upper without a division: i * (den + num) against num * (a + q)."""
    low, high, den = common(lower, upper)
    both = (ones_a + ones_q).cast("long")
    above, below = inter * F.lit(den + low) >= both * F.lit(low), inter * F.lit(den + high) <= both * F.lit(high)
    if high >= den:  # every score is 1 at most
        return above
    return below if low <= 0 else above & below


def integer_bounds(ones_a: int, ones_q: int, lower: float, upper: float) -> tuple[int, int] | None:
    """The intersections that lie within the bounds, or None if there are none."""
    low, high, den = common(lower, upper)
    both = ones_a + ones_q
    first, last = -(-low * both // (den + low)), min(high * both // (den + high), ones_a, ones_q)
    return (first, last) if first <= last else None


def reference(frame: Column, row: Column) -> Column:
    """frame << 19 | row."""
    return F.shiftleft(frame.cast("long"), ROW_BITS).bitwiseOR(row.cast("long"))


def frame_of(ref: Column) -> Column:
    return F.shiftright(ref.cast("long"), ROW_BITS)


def row_of(ref: Column) -> Column:
    return ref.cast("long").bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def onbits_from_name(path: Column) -> Column:
    """The number after the last `_onbits_` of the file name's stem; anything else is an error."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^.*_onbits_([0-9]+)$", 1)
    return F.when(digits != "", digits).otherwise(F.raise_error(F.concat(F.lit("no on-bit count in "), path))).cast("int")


def pack_bits(bits: Column, width: int) -> list[Column]:
    """LONG words of an array of 0/1 numbers."""
    out = []
    for k in range((width + 63) // 64):
        part = F.slice(bits, F.lit(64 * k + 1), F.lit(min(64, width - 64 * k)))
        shifted = F.transform(part, lambda b, i: F.call_function("shiftleft", b.cast("long"), F.lit(63) - i))
        out.append(F.aggregate(shifted, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return out


def register(spark: SparkSession) -> None:
    """SQL functions on array<long> words: fp_intersection(a, b), fp_tanimoto(a, b), fp_centi_score(a, b)."""
    inter = "aggregate(zip_with(a, b, (x, y) -> cast(bit_count(x & y) as bigint)), 0L, (s, x) -> s + x)"
    both = "aggregate(zip_with(a, b, (x, y) -> cast(bit_count(x | y) as bigint)), 0L, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fp_intersection(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN {inter}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fp_tanimoto(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN CASE WHEN {both} = 0 THEN 1D ELSE {inter} / {both} END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fp_centi_score(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT RETURN CASE WHEN {both} = 0 THEN 100 ELSE cast((200 * {inter} + {both}) div (2 * {both}) as int) END")
