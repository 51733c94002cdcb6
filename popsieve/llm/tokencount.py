"""Op 6. Exact token counts at every prefix, by dynamic programming over a piece vocabulary.

The vocabulary's merges never join a space mark to what stands before it, so a text falls into units
(spaces and the characters after them) that are counted apart. In a unit, the last token of a prefix is
the one vocabulary entry ending there that is compatible with the last token of the prefix before it; the
count is one more than there. So one left-to-right pass stores the count of every prefix, and questions
of truncation or budget are look-ups. Counts equal sentencepiece's encode() (no begin or end ids).

Null text counts as empty: 0 tokens, 0 bytes. No shuffle; texts of any length are counted whole.
"""

from __future__ import annotations

import re

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo
from .common import documents, id_and_text, map_texts, strings
from .merges import Merges

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str, units_kept: int = 400_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # merges with a higher score come first; equal scores merge leftmost first
        order = {model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(MARK in piece.lstrip(MARK) for piece in order):
            raise ValueError("pieces of this model join words; units cannot be counted apart")
        self.known = frozenset(order)
        self.merges = Merges(order)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for piece in order:
            self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.automaton.make_automaton()
        self.totals = Memo(lambda unit: self.unit_counts(unit)[-1], units_kept)

    def unit_counts(self, unit: str) -> list[int]:
        """counts[i]: tokens of the first i characters of this unit."""
        pairs, compatible = self.merges.pairs.get, self.merges.compatible
        last, counts, done = [""], [0], 0  # done: prefixes solved so far
        for end, (token, before) in self.automaton.iter(unit):
            if end < done:
                continue
            while done < end:  # a character in no piece is as many tokens as it has bytes
                counts.append(counts[done] + len(unit[done].encode()))
                last.append(unit[done])
                done += 1
            start = end - before
            if not start or pairs((last[start], token)) or compatible(last[start], token):
                last.append(token)
                counts.append(counts[start] + 1)
                done += 1
        for at in range(done, len(unit)):
            counts.append(counts[at] + len(unit[at].encode()))
        return counts

    def units(self, text: str) -> list[str]:
        """Space marks belong to the characters after them; a mark is put before the text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return _UNITS.findall(marked)
        return [MARK + unit for unit in marked[1:].split(MARK)]

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.units(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i]: tokens of text[:i], for every i from 0 to len(text)."""
        out, done = [0], 0
        for k, unit in enumerate(self.units(text)):
            counts = self.unit_counts(unit)
            out += [done + c for c in counts[1 + (k == 0) :]]  # the first mark is no character of the text
            done += counts[-1]
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens; answered from the stored counts."""
        counts = self.prefix_counts(text)
        return text[: max(i for i, c in enumerate(counts) if c <= budget)]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str | None = None) -> PrefixCounter:
    path = path or public_tokenizers.path(MODEL)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = path or public_tokenizers.path(MODEL)

    def make():
        one = counter(path)

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([one.count(t) for t in strings(batch)], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return step

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_texts(rows, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, counts array<int>): tokens of the text's first i characters, i from 0."""
    path = path or public_tokenizers.path(MODEL)

    def make():
        one = counter(path)

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([one.prefix_counts(t) for t in strings(batch)], pa.list_(pa.int32()))], ["doc_id", "counts"])

        return step

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, counts array<int>")


def op6_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))
