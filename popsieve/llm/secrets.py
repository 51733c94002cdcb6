"""Op 10. Secret scans: fixed patterns, and the guess cost of values in a credential's context.

Base spans are leftmost, non-overlapping matches per kind (assign, access, hex); matches that fail their
length rule are dropped without retries. The method looks at values that follow a credential's name in ways
the base patterns don't take ("the password is ...", "pwd: ...") and asks how many guesses a cracker
would need: the cheapest segmentation of the value into words, dates, repeats, keyboard walks and
brute-force spans, by dynamic programming. Words are a short list of usual passwords, and after them, by frequency,
the up to CORPUS_WORDS words that most documents of the table have (counted over all of them). Values of MIN_COST decimal digits of guesses or more that
overlap no base span are added as kind `guess`; base spans stay.

Null text counts as empty, and an empty table gives no rows. Positions are code points, ends exclusive. Texts and values
of any length are read whole. Rows, repeated ones too, are mapped one by one; of texts nothing shuffles but counts of
words, summed before they do. Words in the same number of documents rank by themselves. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, id_and_text, map_texts, strings

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs; a shorter run holds no match of its own, so the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Names of credentials and what may stand between them and a value.
CONTEXT = re.compile(r"""(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization)?))["']?\s{0,3}(?:(?:is|was)\b:?|=>|:=|[:=])\s{0,3}(?:Bearer\s)?["'`]?([!-~]{8,})""")
CUES = ("pass", "pwd", "secret", "token", "credential", "key", "auth")
#: Decimal digits of guesses from which a value counts as a secret.
MIN_COST = 9.0
#: Characters of a value from which the recurrence checks whether its cost can still fall below MIN_COST.
STRETCH = 200
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0987654321", "poiuytrewq", "lkjhgfdsa", "mnbvcxz", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")
#: Words of the corpus that a cracker is taken to know, and their length.
CORPUS_WORDS, WORD_LENGTH = 20_000, (3, 12)
#: Levels of frequency to an octave.
LEVELS = 8
#: Common words by rank; a word costs its rank in guesses.
WORDS = """password admin welcome letmein monkey dragon master login hello secret football shadow sunshine princess
love user test guest root access freedom whatever money summer winter spring autumn monday friday orange apple
computer internet server service public private the and for you with this that not required optional none null
true false unknown hidden redacted example sample changeme default empty string value token key name here your
my is of in to on reset expired invalid missing wrong correct strong weak forgotten protected needed set""".split()
_RANK = {word: k + 2 for k, word in enumerate(WORDS)}
_LEET = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def brute_force(text: str) -> float:
    """Decimal digits of guesses for one span of any characters."""
    size = 10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 33 * any(not c.isalnum() for c in text)
    return len(text) * math.log10(max(size, 10))


def _runs(value: str) -> list[list[int]]:
    """For units of 1 to 8: from each place, how many characters equal the one a unit further."""
    out = []
    for unit in range(1, 9):
        counts = [0] * (len(value) + 1)
        for at in range(len(value) - unit - 1, -1, -1):
            if value[at] == value[at + unit]:
                counts[at] = counts[at + 1] + 1
        out.append(counts)
    return out


def _spans_at(value: str, start: int, runs: list[list[int]], rank_of: dict[str, int]):
    """(start, end, cost) of every word, date, repeat and keyboard walk that starts there; runs are those of _runs()."""
    near = value[start : start + 32]
    low = near.lower()
    plain = low.translate(_LEET)
    for size in range(2, min(len(near), 12) + 1):
        rank = rank_of.get(low[:size]) or rank_of.get(plain[:size])
        if rank:
            yield start, start + size, math.log10(rank * (1 if near[:size] == low[:size] else 4))
    date = _DATE.match(value, start)
    if date:
        yield start, date.end(), math.log10(365 * 150)
    for unit in range(1, min(8, (len(value) - start) // 2) + 1):
        end = start + unit + runs[unit - 1][start] // unit * unit
        if end > start + unit:
            yield start, end, brute_force(value[start : start + unit]) + math.log10((end - start) / unit)
    for walk in WALKS:
        at = walk.find(low[0])
        size = 0
        while at >= 0 and size < len(near) and at + size < len(walk) and walk[at + size] == low[size]:
            size += 1
        if size >= 3:
            yield start, start + size, math.log10(len(WALKS) * 26 * size)


def _spans(value: str, rank_of: dict[str, int]):
    """(start, end, cost) of every word, date, repeat and keyboard walk in the value."""
    runs = _runs(value)
    for start in range(len(value)):
        yield from _spans_at(value, start, runs, rank_of)


def guess_cost(value: str, rank_of: dict[str, int] = _RANK) -> float:
    """Decimal digits of the guesses that the cheapest segmentation needs."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in _spans(value, rank_of):
        ending.setdefault(end, []).append((start, cost))
    for end in range(1, n + 1):
        for start in range(end):
            best[end] = min(best[end], best[start] + brute_force(value[start:end]))
        for start, cost in ending.get(end, ()):
            best[end] = min(best[end], best[start] + cost)
    return best[n]


def costly(value: str, rank_of: dict[str, int] = _RANK) -> bool:
    """guess_cost(value) >= MIN_COST, in time in proportion to the value's length.

    A brute-force span costs a digit for each character at least, so one that can matter is short of MIN_COST characters;
    and a place that no segmentation reaches below MIN_COST leads nowhere cheaper."""
    n, reach = len(value), math.ceil(MIN_COST)
    if n <= STRETCH:
        return guess_cost(value, rank_of) >= MIN_COST
    best, runs = [0.0] + [math.inf] * n, _runs(value)
    last = 0  # the farthest place reached below MIN_COST
    for start in range(n):
        if start > last:
            return True
        if best[start] >= MIN_COST:
            continue
        for end in range(start + 1, min(n, start + reach) + 1):
            best[end] = min(best[end], best[start] + brute_force(value[start:end]))
            if best[end] < MIN_COST:
                last = max(last, end)
        for _, end, cost in _spans_at(value, start, runs, rank_of):
            best[end] = min(best[end], best[start] + cost)
            if best[end] < MIN_COST:
                last = max(last, end)
    return best[n] >= MIN_COST


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], rank_of: dict[str, int] = _RANK) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(cue in low for cue in CUES):
        return []
    out = []
    for match in CONTEXT.finditer(text):
        value = match[1].rstrip("\"'`,;.)]}>")
        start, end = match.start(1), match.start(1) + len(value)
        varied = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value), any(not c.isalnum() for c in value)))
        if len(value) >= 8 and varied >= 2 and any(c.isdigit() for c in value) and not any(s < end and start < e for s, _, e in base) and costly(value, rank_of):
            out.append((start, 3, end))
    return out


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def word_ranks(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> dict[str, int]:
    """Ranks of the usual passwords and then of the words in most documents: as many whole levels of frequency (an eighth
    of an octave each) as have `most` words together, which is all that the driver gets.

    Only words that stand by themselves count, so that parts of a credential don't become words by its being in the table."""
    low, high = WORD_LENGTH
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"""[\s.,;:!?()"']+"""))).alias("word"))
    words = words.where(F.length("word").between(low, high) & F.col("word").rlike("^[a-z]+$"))
    scratch = Scratch(docs.sparkSession)
    counts = scratch.written(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("level", F.floor(F.log2("n") * LEVELS).cast("int")), "word-counts")
    least, size = None, 0
    for level in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundred rows
        size += level["count"]
        if size > most:
            break
        least = level["level"]
    found = [] if least is None else sorted(counts.where(F.col("level") >= least).collect(), key=lambda row: (-row["n"], row["word"]))  # `most` rows at most
    scratch.drop()
    ranks = dict(_RANK)
    for row in found:
        ranks.setdefault(row["word"], len(ranks) + 2)
    return ranks


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> of every document, by start and then kind."""
    ranks = word_ranks(docs, text_col)

    def make():
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

        def step(batch):
            rows = []
            for text in strings(batch):
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in sorted(base + added_spans(text, base, ranks))])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

        return step

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, hash and text of find_secrets()."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), counts[3])


def op10_secret_scan(spark, sf_dir):
    return digest(find_secrets(documents(spark, sf_dir)))
