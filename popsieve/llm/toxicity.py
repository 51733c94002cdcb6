"""Op 4. Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its hashed character n-grams (3 to 5 bytes of "<word>", and the
whole; runs without blanks of over LONGEST bytes count as overlapping stretches), a window of WINDOW words the average of its words, and a two-class softmax over it is linear; vectors
and softmax are trained jointly in numpy on the driver, from a bounded sample of labelled rows. Unseen
misspellings share most n-grams with the words they come from. Labels mark whole documents, so training
starts with all windows of a toxic document as toxic and goes on with its highest ones alone. A
document's score is its highest window's, calibrated on the training documents to the labels' rate.

Since the model is linear, a word's part in any window is one number, memoised by word; whole texts are
scored in one pass, whatever their length. Null counts as empty; an empty text scores as a window of no words
does. Without labelled texts of both kinds that have words every score is 0. Rows repeated in `labels` count as toxic
if any of them does; repeated documents score alike. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo
from .common import documents, held_out, id_and_text, map_texts, strings

#: Places of hashed n-grams, numbers in a vector, words in a window.
BUCKETS = 1 << 16
SIZE = 8
WINDOW = 24
#: The sample: labelled rows of each kind at most (about), and windows of each of them.
PER_LABEL = 1500
WINDOWS_PER_DOC = 80
THRESHOLD = 0.3
#: Bytes of the longest word; characters of the stretches of longer ones, and how many two of them share.
LONGEST, STRETCH, OVERLAP = 64, 16, 6
#: Steps of each round at least, however small the sample.
STEPS = 60


def split(text: str) -> list[str]:
    """The words of a text; of a run of over LONGEST bytes, stretches that overlap."""
    out = []
    for word in text.lower().split():
        if len(word) <= LONGEST and len(word.encode()) <= LONGEST:
            out.append(word)
        else:
            out.extend(word[k : k + STRETCH] for k in range(0, max(1, len(word) - OVERLAP), STRETCH - OVERLAP))
    return out


def grams(word: str) -> list[int]:
    data = b"<" + word.encode() + b">"
    crc, n = zlib.crc32, len(data)
    return [crc(data) % BUCKETS, *(crc(data[i : i + k]) % BUCKETS for k in (3, 4, 5) for i in range(n - k + 1))]


@dataclass
class Model:
    """parts: what each n-gram adds to the softmax's log-odds; base: its bias; slope, shift: calibration."""

    parts: np.ndarray
    base: float
    slope: float
    shift: float
    trained: bool = True

    def odds(self):
        """Text -> the log-odds of its highest window."""
        parts = self.parts.tolist()

        def word_part(word: str) -> float:
            found = grams(word)
            return sum(map(parts.__getitem__, found)) / len(found)

        memo = Memo(word_part, 400_000).__getitem__

        def top(text: str) -> float:
            words = split(text)
            return highest(np.fromiter(map(memo, words), np.float64, len(words))) + self.base

        return top

    def scorer(self):
        top = self.odds()

        def score(text: str) -> float:
            if not self.trained:
                return 0.0
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * top(text) + self.shift))))

        return score


def highest(values: np.ndarray) -> float:
    """The highest average over the windows from every word on."""
    n = len(values)
    if n <= WINDOW:
        return float(values.mean()) if n else 0.0
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW)


def windows(words: list[str], most: int) -> list[list[str]]:
    if len(words) <= WINDOW:
        return [words]
    starts = [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]
    if len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return [words[s : s + WINDOW] for s in starts]


def set_apart(labels: np.ndarray) -> np.ndarray:
    """Whether a document only calibrates: every fourth of either label."""
    apart = np.zeros(len(labels), bool)
    for label in (0, 1):
        apart[np.flatnonzero(labels == label)[3::4]] = True
    return apart


def fit(samples: list[tuple[list[list[str]], int, float]], epochs: int = 3, rounds: int = 3, batch: int = 512, rate: float = 0.05, decay: float = 0.1) -> Model:
    """samples: (windows of a document, label, weight). The weight undoes the sample's share of its label.

    Every fourth document of either label only calibrates; the others train.
    """
    if len({label for _, label, _ in samples}) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, trained=False)
    rng = np.random.default_rng(4)
    number: dict[str, int] = {}
    flat, sizes, owner = [], [], []
    for doc, (parts, _, _) in enumerate(samples):
        for words in filter(None, parts):
            flat.extend(number.setdefault(w, len(number)) for w in words)
            sizes.append(len(words))
            owner.append(doc)
    flat, sizes, owner = (np.array(x, np.int64) for x in (flat, sizes, owner))
    labels = np.array([label for _, label, _ in samples])
    apart = set_apart(labels)
    if len(set(labels[owner][~apart[owner]])) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, trained=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    gram_lists = [grams(w) for w in number]
    gram_at = np.concatenate(([0], np.cumsum([len(g) for g in gram_lists])))
    gram_flat = np.fromiter((g for gs in gram_lists for g in gs), np.int64, gram_at[-1])
    del gram_lists
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE))
    weights, bias = rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, weights, bias)]
    ticks = 0

    def word_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = gram_at[words + 1] - gram_at[words]
        at = np.repeat(gram_at[words] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        ids = gram_flat[at]
        sums = np.add.reduceat(vectors[ids], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
        return sums / lengths[:, None], ids, lengths

    def step(chosen: np.ndarray) -> None:
        nonlocal ticks
        n = sizes[chosen]
        tokens = flat[np.repeat(starts[chosen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        words, inverse = np.unique(tokens, return_inverse=True)
        of_word, ids, lengths = word_vectors(words)
        firsts = np.concatenate(([0], np.cumsum(n)[:-1]))
        bags = np.add.reduceat(of_word[inverse], firsts, axis=0) / n[:, None]
        logits = bags @ weights + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        y = labels[owner[chosen]]
        p[np.arange(len(y)), y] -= 1
        p *= (np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())))[:, None]
        to_bag = p @ weights.T
        to_word = np.stack([np.bincount(inverse, np.repeat(to_bag[:, k] / n, n), len(words)) for k in range(SIZE)], 1)
        spread = np.repeat(to_word / lengths[:, None], lengths, axis=0)
        used, where = np.unique(ids, return_inverse=True)
        to_vectors = np.stack([np.bincount(where, spread[:, k], len(used)) for k in range(SIZE)], 1)
        ticks += 1
        for x, grad, (m, v), rows in ((vectors, to_vectors, state[0], used), (weights, bags.T @ p, state[1], slice(None)), (bias, p.sum(0), state[2], slice(None))):
            m[rows] = 0.9 * m[rows] + 0.1 * grad
            v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
            x[rows] -= rate * decay * x[rows] + rate * (m[rows] / (1 - 0.9**ticks)) / (np.sqrt(v[rows] / (1 - 0.99**ticks)) + 1e-9)

    def parts() -> tuple[np.ndarray, float]:
        return vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])

    def window_odds() -> np.ndarray:
        part, base = parts()
        word = np.add.reduceat(part[gram_flat], gram_at[:-1]) / np.diff(gram_at)
        return np.add.reduceat(word[flat], starts[:-1]) / sizes + base

    usable = ~apart[owner]
    pool = np.flatnonzero(usable)
    for turn in range(rounds):
        if turn:  # of a toxic document, go on with its highest windows, at last the very highest
            odds = window_odds()
            order = np.lexsort((-odds, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            good = np.zeros(len(odds), bool)
            good[order] = rank < rounds - turn
            pool = np.flatnonzero(usable & (good | (labels[owner] == 0)))
        toxic = labels[owner[pool]] == 1
        for _ in range(max(epochs, math.ceil(STEPS * batch / max(1, (~toxic).sum())))):
            ones, zeros = rng.permutation(pool[toxic]), rng.permutation(pool[~toxic])
            for k in range(math.ceil(len(zeros) / batch)):
                some = rng.choice(ones, min(len(ones), batch // 4), replace=False)
                step(np.concatenate((zeros[k * batch : (k + 1) * batch], some)))
    part, base = parts()
    word = np.add.reduceat(part[gram_flat], gram_at[:-1]) / np.diff(gram_at)
    tops = np.full(len(samples), -np.inf)
    np.maximum.at(tops, owner, np.add.reduceat(word[flat], starts[:-1]) / sizes + base)
    tops[np.isinf(tops)] = base  # no words
    fresh = apart if len(set(labels[apart])) == 2 else ~apart | apart
    slope, shift = calibrated(tops[fresh], labels[fresh], np.array([w for _, _, w in samples])[fresh])
    return Model(part, base, slope, shift)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x, lightly held to 0, by Newton's method."""
    scale, middle = max(1e-9, x.std()), x.mean()
    z = np.stack(((x - middle) / scale, np.ones_like(x)), 1)
    weight, beta = weight / weight.mean(), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 0.5 * np.array([beta[0], 0])
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.5, 1e-6])
        move = np.linalg.solve(hess, grad)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Learn from labelled rows that aren't held out; a repeatable sample by hashed id."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = dict(map(tuple, marks.groupBy("label").count().collect()))  # two rows
    if len(counts) < 2:
        return fit([])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    share = {label: min(1.0, per_label / n) for label, n in counts.items()}
    taken = marks.where(chance < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(taken), "doc_id").select("doc_id", "label", "text")  # about 2 * per_label rows

    def make():
        def step(batch):
            found = [[" ".join(w) for w in windows(split(text), WINDOWS_PER_DOC)] for text in strings(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "windows"])

        return step

    found = map_texts(rows, make, "doc_id long, label int, windows array<string>").toArrow().sort_by("doc_id").to_pylist()
    model = fit([([w.split() for w in row["windows"]], row["label"], 1 / share[row["label"]]) for row in found])
    apart = set_apart(np.array([row["label"] for row in found]))
    if not model.trained or len({row["label"] for row, k in zip(found, apart, strict=True) if k}) < 2:
        return model
    # once more, on scores of whole texts as predict() has them
    whole = rows.where(F.col("doc_id").isin([row["doc_id"] for row, k in zip(found, apart, strict=True) if k]))

    def make_tops():
        top = model.odds()

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(map(top, strings(batch)), pa.float64())], ["label", "top"])

        return step

    tops = sorted((r["label"], r["top"]) for r in map_texts(whole, make_tops, "label int, top double").collect())
    y, x = np.array([label for label, _ in tops]), np.array([top for _, top in tops])
    model.slope, model.shift = calibrated(x, y, np.array([1 / share[label] for label in y.tolist()]))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def make():
        score = model.scorer()

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(score, strings(batch)), pa.float64())], ["doc_id", "score"])

        return step

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
