"""Op 8. Language ID by string kernels.

Two texts' kernel is the cosine of their sets of blended-spectrum n-grams (1 to 3 bytes, ASCII lower-cased,
presence only, hashed into DIM places). A bounded sample of labelled rows, LANDMARKS of them as
Nyström landmarks, trains one-versus-rest kernel ridge regression on the driver from packed bit sets
(DIM / 8 bytes a row). Whole texts are scored in blocks by two matrix products: block x landmarks,
then landmarks x languages.

The places would fill up with a long text's n-grams, so a text is scored in stretches of about STRETCH bytes, each a
kernel row of its own, and its score is their average by length. A training row is one stretch of its text,
picked by hashed id.

A text that is null or has no letter is `und` with score 0, and so is every text when no row is labelled. Ties
between languages go to the first in order of code. No shuffle of texts; repeated rows score alike. An empty table
gives no rows; other columns are not read unless asked for.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, map_texts

DIM = 1 << 14
GRAMS = (1, 2, 3)
#: Labelled rows taken for training from each language at most (about), and landmarks in all.
PER_LANGUAGE = 1000
LANDMARKS = 128
RIDGE = 1e-2
UNKNOWN = "und"
BLOCK = 64
#: Bytes of a stretch (about): texts up to half as long again are one.
STRETCH = 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPREAD = (np.uint32(2654435769), np.uint32(2246822519), np.uint32(3266489917))


def presence(data: np.ndarray, row: np.ndarray) -> None:
    """Set in `row` the places of the n-grams of these bytes."""
    part = _LOWER[data].astype(np.uint32)
    code = part
    for n, spread in zip(GRAMS, _SPREAD, strict=True):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
        row[((code + np.uint32(n)) * spread) >> np.uint32(32 - 14)] = 1


def stretches(data: np.ndarray) -> list[np.ndarray]:
    """The text in parts of like length; together they have all its bytes."""
    n = max(1, round(len(data) / STRETCH))
    return [data[k * len(data) // n : (k + 1) * len(data) // n] for k in range(n)]


def byte_views(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each string, without copies; null gives none."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return [body[:0] if null else body[a:b] for a, b, null in zip(at[:-1], at[1:], nulls, strict=True)]


@dataclass
class Model:
    """languages in order; landmarks: packed bit sets, a row each; weights: landmarks x languages."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self):
        marks = np.unpackbits(self.landmarks, axis=1)[:, :DIM].astype(np.float32)
        marks /= np.sqrt(np.maximum(1, marks.sum(1, keepdims=True)))
        marks = np.ascontiguousarray(marks.T)
        weights = self.weights.astype(np.float32)

        def scores(texts: list[np.ndarray]) -> np.ndarray:
            parts = [stretches(data) for data in texts]
            flat, firsts = [x for own in parts for x in own], np.cumsum([0, *map(len, parts)])[:-1]
            found = of_stretches(flat)
            weights = np.array([max(1, len(x)) for x in flat], np.float64)
            return np.add.reduceat(found * weights[:, None], firsts) / np.add.reduceat(weights, firsts)[:, None]

        def of_stretches(texts: list[np.ndarray]) -> np.ndarray:
            out = []
            for start in range(0, len(texts), BLOCK):
                part = texts[start : start + BLOCK]
                bits = np.zeros((len(part), DIM), np.float32)
                for row, data in zip(bits, part, strict=True):
                    presence(data, row)
                kernel = bits @ marks / np.sqrt(np.maximum(1, bits.sum(1, keepdims=True)))
                out.append(kernel @ weights + self.bias)
            return np.concatenate(out)

        return scores


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression of one language against the rest, on Nyström features of `bits` (packed)."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1, DIM // 8), np.uint8), np.zeros((1, 1)), np.zeros(1))
    place = {language: [i for i, x in enumerate(labels) if x == language] for language in languages}
    each = max(1, landmarks // len(languages))
    chosen = [i for language in languages for i in place[language][:each]]
    x = np.unpackbits(bits, axis=1)[:, :DIM].astype(np.float32)
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    kernel = (x @ x[chosen].T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # K_mm ** -1/2
    z = kernel @ root
    y = np.array([[float(a == b) for b in languages] for a in labels])
    balance = np.array([1 / len(place[a]) for a in labels])  # languages count alike
    balance /= balance.mean()
    mean_z, mean_y = np.average(z, axis=0, weights=balance), np.average(y, axis=0, weights=balance)
    zc, yc = z - mean_z, y - mean_y
    coef = np.linalg.solve((zc * balance[:, None]).T @ zc + ridge * len(labels) * np.eye(zc.shape[1]) / 100, (zc * balance[:, None]).T @ yc)
    return Model(languages, bits[chosen], root @ coef, mean_y - mean_z @ coef)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows with a lang that aren't held out; a repeatable sample by hashed id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("doc_id") & F.col("lang").isNotNull())
    usable = rows.where(F.col("text").rlike(r"\p{L}"))
    share = rows.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share"))  # a row a language
    chance = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    taken = usable.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("doc_id", "lang", "text")

    def make():
        def step(batch):
            packed = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text")), strict=True):
                row, parts = np.zeros(DIM, np.uint8), stretches(data)
                presence(parts[zlib.crc32(str(doc_id).encode()) % len(parts)], row)
                packed.append(np.packbits(row).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang").cast(pa.string()), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

        return step

    found = map_texts(taken, make, "doc_id long, lang string, bits binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(-1, DIM // 8)
    return fit(bits, found.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and the columns in `keep`) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"), *(c for c in keep if c != text_col))
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def make():
        scores = model.scorer()

        def step(batch):
            letter = batch.column("_letter").to_pylist()
            if model.languages:
                found = scores(byte_views(batch.column("_text")))
                best = found.argmax(1)
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)]
                score = [float(min(1.0, max(0.0, row[k]))) if ok else 0.0 for row, k, ok in zip(found, best, letter, strict=True)]
            else:
                lang, score = [UNKNOWN] * len(letter), [0.0] * len(letter)
            return pa.RecordBatch.from_arrays([batch.column("_id"), *(batch.column("_text" if c == text_col else c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

        return step

    return map_texts(rows, make, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of its labelled rows."""
    model = train(docs, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir))
