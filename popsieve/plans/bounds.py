"""Pruning by on-bits: which partitions, and which queries in them, can hold a score within bounds.

All of it is exact integer arithmetic on the driver, over at most bits + 1 on-bit counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.similarity import common


def may_match(onbits: int, ones_q: int, bits: int, lower: float, upper: float) -> bool:
    """Whether a row of `onbits` can score within [lower, upper] against a query of `ones_q` on-bits."""
    if ones_q <= 0 or lower > upper:
        return False
    low, high, den = common(lower, upper)
    if min(onbits, ones_q) * den < low * max(onbits, ones_q):
        return False
    least = max(0, onbits + ones_q - bits)  # bits that must coincide
    return least * den <= high * (onbits + ones_q - least)


def shortlist(ones: Sequence[int], onbits: int, bits: int, lower: float, upper: float) -> list[int]:
    """Numbers of the queries that rows of `onbits` can match."""
    return [k for k, q in enumerate(ones) if may_match(onbits, q, bits, lower, upper)]


def allowed(ones: Sequence[int], bits: int, lower: float, upper: float) -> list[tuple[int, int]]:
    """(query, on-bit count) of all that may match; each distinct query weight is worked out once."""
    found: dict[int, list[int]] = {}
    for q in set(ones):
        found[q] = [a for a in range(bits + 1) if may_match(a, q, bits, lower, upper)]
    return [(k, a) for k, q in enumerate(ones) for a in found[q]]
