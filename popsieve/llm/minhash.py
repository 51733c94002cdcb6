"""Op 1. Near-dedup by SetSketch registers.

A document's set is its distinct word shingles. Register i holds the smallest of the set's values under hash i,
as the number of its step on an exponential scale (base BASE, so a step is a tenth of a per cent): a
truncated minimum. Sketches merge by taking greater registers, and equal registers show likeness.

1. One pass over the texts writes sketch, set size and set digest of every document.
2. Documents with equal sets are one class, whatever their number; only classes go on.
3. Bands of ROWS registers are hashed. In every bucket the class with the most company in all its buckets is the hub, and
   each other class is paired with it: as many pairs as members at most, however large the bucket. The classes that are paired
   with a hub in any band are its star, so a group of copies is one star or a few, not a bucket in every band. Where a star's
   classes lie in several components after that, those of different ones that share a bucket are compared and verified in blocks, which
   give only links that join components; a large star gets further hubs from its outlying components first, round by
   round. So every two classes that share a bucket end up compared, or in one component already.
4. Pairs are dropped only if the joint likelihood of their registers, given the set sizes, is far better
   (MARGIN in log) at some lower similarity than at the threshold; the rest are verified on full sets.
5. Components of the verified links by large-star and small-star steps.

Two sets at similarity 0.8 share no bucket with probability (1 - 0.8**5)**36 < 1e-6. Null, empty and
wordless texts have no set and link with nothing. Rows that share an id are one document, linked with all that
any of their texts links with; each row keeps its own set size. A null id links with nothing. An empty table gives
no rows; other columns are not read. Texts of any length are read whole, in stretches; a set is held in
one task (8 bytes a shingle). A hub's members are verified in salted groups of about GROUP, its text going to each.
Joins by set, bucket or star send no hot one to a single task. The work on a star that stays open after HUB_ROUNDS
grows with the square of its classes, in blocks that are tasks of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, given_back, id_and_text, map_arrow, map_texts
from .components import components
from .langid import byte_views
from .shingles import WORDS, shingle_set

BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
THRESHOLD = 80  # per cent
MARGIN = 12.5
GROUP = 64
#: Classes, and shingles, of one star that make a block; stars over LARGE get further hubs before that.
BLOCK, BLOCK_SHINGLES, LARGE, HUB_ROUNDS = 512, 2_000_000, 8192, 6
#: Pairs of classes that a task compares by sketch (about), and tasks of a stage at most.
TASK_PAIRS, MOST_TASKS = 250_000, 20_000
#: Ids broadcast at most (8 bytes each, or 40 with a digest); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(1)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def registers(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes, as unsigned 16-bit numbers; of no hashes, zeros."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for start in range(0, len(short), step):
        values = short[start : start + step, None] ^ _XOR
        values *= _TIMES
        np.minimum(least, values.min(0), out=least)
    spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE  # an exponential minimum
    return np.clip(np.floor(1 - np.log(spaced) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _step_probability(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(similarity: np.ndarray, more: np.ndarray, fewer: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of the counts of registers where a is greater, and less, than b."""
    share = n_a / (n_a + n_b)
    p_more = np.clip(_step_probability(share - (1 - share) * similarity), 1e-7, 1)
    p_fewer = np.clip(_step_probability((1 - share) - share * similarity), 1e-7, 1)
    p_same = np.clip(1 - p_more - p_fewer, 1e-7, 1)
    return more * np.log(p_more) + fewer * np.log(p_fewer) + (REGISTERS - more - fewer) * np.log(p_same)


def plausible(more, fewer, n_a, n_b, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether the pair may reach the threshold, by a likelihood ratio over lower similarities (in steps, which can only let more on)."""
    more, fewer, n_a, n_b = (np.asarray(x, np.float64) for x in (more, fewer, n_a, n_b))
    fits = 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    bound = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    at = log_likelihood(np.minimum(threshold / 100, bound), more, fewer, n_a, n_b)
    best = np.full(len(more), -np.inf)
    for s in np.arange(0, threshold / 100 - 0.01, 0.1):
        best = np.maximum(best, log_likelihood(np.minimum(s, bound), more, fewer, n_a, n_b))
    return fits & (at >= best - MARGIN)


def sketched(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), sketch of (doc_id, text)."""

    def make():
        def step(batch):
            sizes, digests, sketches = [], [], []
            for data in byte_views(batch.column("text")):
                found = shingle_set(data, words)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketches.append(registers(found).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

        return step

    return map_texts(rows, make, "doc_id long, n_shingles long, digest binary, sketch binary")


def banded(sketches: DataFrame) -> DataFrame:
    """(band, key, class): a row per band of a sketch; key is a hash of the band's number and registers."""
    keys = [F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)).alias("key")) for k in range(BANDS)]
    return sketches.select(F.col("class"), F.explode(F.array(*keys)).alias("_")).select("_.band", "_.key", "class")


def hubbed(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, class): the members of buckets of several, but for the hub, which is the member whose buckets of all
    bands are largest together: copies resemble what they were made from more than each other, so one hub tends to join all."""
    keys = ["band", "key"]
    sizes = scratch.written(bands.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("n", F.col("_n")), "bucket-sizes")
    near = F.sum("n").over(Window.partitionBy("class"))  # a row a band at most
    members = scratch.written(given_back(bands, sizes, keys, scratch).select(*keys, "class", "n", near.alias("near")), "members")
    hubs = members.groupBy(*keys).agg(F.max_by("class", F.struct("near", -F.col("class"))).alias("hub"), F.max("n").alias("_n"))
    return given_back(members.select(*keys, "class"), scratch.written(hubs, "hubs"), keys, scratch).select("hub", "class").where("class != hub")


def _once(rows: DataFrame) -> DataFrame:
    """(low, high, hub, class): each two of a hub and a class once, whichever is the hub."""
    pairs = rows.groupBy(F.least("hub", "class").alias("low"), F.greatest("hub", "class").alias("high")).agg(F.min("hub").alias("hub"))
    return pairs.withColumn("class", F.when(F.col("hub") == F.col("low"), F.col("high")).otherwise(F.col("low")))


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (hub, class) whose sketches leave the threshold open."""
    side = sketches.select("class", "n_shingles", "sketch")
    rows = pairs.join(side.toDF("hub", "n_a", "a"), "hub").join(side.toDF("class", "n_b", "b"), "class").select("hub", "class", "n_a", "n_b", "a", "b")

    def make():
        def step(batch):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in "ab")
            good = plausible((a > b).sum(1), (a < b).sum(1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            return batch.select(["hub", "class"]).filter(pa.array(good))

        return step

    return map_texts(rows, make, "hub long, class long")


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def class_texts(wanted: DataFrame, classes: DataFrame, texts: DataFrame, words: int, mixed_ids: bool, scratch: Scratch) -> DataFrame:
    """(class, text) of the wanted classes, from texts (doc_id, text). With mixed_ids, an id may stand for texts of several
    classes, and a text is taken for the class whose set it has."""
    ids = scratch.written(classes.join(_few(wanted), "class", "left_semi").select("class", "doc_id", "digest"), "class-ids")
    found = _few(ids)
    found = texts.join(found, "doc_id").select("class", "digest", "text")
    if not mixed_ids:
        return found.select("class", "text")

    def make():
        def step(batch):
            same = [hashlib.blake2b(shingle_set(data, words).tobytes(), digest_size=16).digest() == digest for data, digest in zip(byte_views(batch.column("text")), batch.column("digest").to_pylist(), strict=True)]
            return batch.select(["class", "text"]).filter(pa.array(same))

        return step

    return map_texts(found, make, "class long, text string").dropDuplicates(["class"])


def verified(pairs: DataFrame, fetch, scratch: Scratch, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b): the pairs (hub, class) whose full sets reach the threshold. fetch(wanted) gives (class, text)."""
    degree = pairs.groupBy("hub").agg(F.count("*").alias("_n")).withColumn("salts", F.ceil(F.col("_n") / GROUP))
    salted = given_back(pairs, scratch.written(degree, "degrees"), ["hub"], scratch)
    salted = scratch.written(salted.select("hub", "class", F.pmod(F.xxhash64("class"), F.col("salts")).alias("salt")), "salted-pairs")
    ids = scratch.written(salted.select(F.explode(F.array("hub", "class")).alias("class")).distinct(), "pair-ids")
    wanted = scratch.written(fetch(ids), "pair-texts").withColumnRenamed("class", "_of")
    members = salted.join(wanted, F.col("class") == F.col("_of")).select("hub", "salt", F.lit(1).alias("side"), "class", "text")
    hubs = salted.select("hub", "salt").distinct().join(wanted, F.col("hub") == F.col("_of")).select("hub", "salt", F.lit(0).alias("side"), F.col("hub").alias("class"), "text")
    rows = hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")

    def run(batches):
        hub, full = None, None
        for batch in batches:
            links = []
            for of, salt, side, other, data in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "side", "class")), byte_views(batch.column("text")), strict=True):
                found = shingle_set(data, words)
                if side == 0:
                    hub, full = (of, salt), found
                elif hub == (of, salt):
                    both = in_both(full, found)
                    if both and 100 * both >= threshold * (len(full) + len(found) - both):
                        links.append((other, of))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def _open_stars(stars: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of stars (star, class, component, n, hub, hub_component) that lie in several components; the hub is in an
    outlying one (the main one tends to have the least label)."""
    rows = scratch.written(stars.join(joined, stars["class"] == joined["node"], "left").select("star", "class", F.coalesce("component", "class").alias("component")), "star-components")
    several = rows.groupBy("star").agg(F.min("component").alias("_low"), F.max("component").alias("hub_component"), F.count("*").alias("_n"), F.max_by("class", "component").alias("hub")).where("_low != hub_component")
    several = scratch.written(several.drop("_low").withColumn("n", F.col("_n")), "several")
    return scratch.written(given_back(rows, several, ["star"], scratch), "open")


def _sketch_matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _partners(table: pa.Table):
    """A function k, comps, some -> rows of this block to compare with row k: among some (a mask), in another component,
    sharing a bucket, and likely by their sketches. It reads the components anew each time."""
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    sketch = _sketch_matrix(table)
    classes, owns, sizes = (table.column(c).to_numpy() for c in ("class", "own", "n_shingles"))

    def of(k: int, comps: np.ndarray, some: np.ndarray | bool = True) -> np.ndarray:
        others = np.flatnonzero(some & (comps != comps[k]) & ((classes > classes[k]) if same else (owns > owns[k])))
        if not len(others):
            return others
        others = others[(sketch[others] == sketch[k]).reshape(-1, BANDS, ROWS).all(2).any(1)]
        a, b = sketch[k], sketch[others]
        return others[plausible((a > b).sum(1), (a < b).sum(1), np.full(len(others), sizes[k]), sizes[others])]

    return of


def block_links(rows: DataFrame, sketches: DataFrame, fetch, scratch: Scratch, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the components of the classes of each open star, compared in blocks.

    A star falls into blocks of about BLOCK classes or BLOCK_SHINGLES shingles; each two blocks meet once. A task
    gets about TASK_PAIRS pairs; as rows are few, adaptive execution would else run all in a handful of tasks. A first pass on sketches
    keeps the classes that have someone to be compared with; only their texts are dealt. The second verifies full
    sets where they meet and gives the links that join components, never a block's pairs.
    """
    rows = scratch.written(rows.select("star", "class", "component").join(sketches.select("class", "n_shingles"), "class"), "block-rows")
    weights = rows.groupBy("star").agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    weights = scratch.written(weights, "block-weights")
    pairs = weights.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = int(min(MOST_TASKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS)))
    blocks = given_back(rows, weights, ["star"], scratch).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = blocks.select("star", "class", "component", "n_shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_with"))
    dealt = dealt.join(sketches.select("class", "sketch"), "class")
    dealt = dealt.select("star", F.least("own", "_with").alias("i"), F.greatest("own", "_with").alias("j"), "own", "class", "component", "n_shingles", "sketch")
    meeting = ["star", "i", "j"]

    def busy(table: pa.Table) -> pa.Table:
        comps, of = table.column("component").to_numpy(), _partners(table)
        wanted = np.zeros(len(comps), bool)
        for k in range(len(comps)):
            others = of(k, comps, ~wanted if wanted[k] else True)  # who is wanted already needn't be found again
            wanted[others] = True
            wanted[k] |= bool(len(others))
        return table.filter(pa.array(wanted))

    def compare(table: pa.Table) -> pa.Table:
        comps, of = table.column("component").to_numpy().copy(), _partners(table)
        classes, links = table.column("class").to_numpy(), []
        sets = [shingle_set(data, words) for column in table.column("text").chunks for data in byte_views(column)]
        for k in range(len(sets)):
            for other in of(k, comps):
                if comps[other] == comps[k]:
                    continue
                both = in_both(sets[k], sets[other])
                if both and 100 * both >= threshold * (len(sets[k]) + len(sets[other]) - both):
                    links.append((classes[other], classes[k]))
                    comps[comps == comps[other]] = comps[k]
        return pa.table({name: pa.array([link[n] for link in links], pa.int64()) for n, name in enumerate("ab")})

    work = scratch.written(dealt.repartition(tasks, *meeting).groupBy(*meeting).applyInArrow(busy, dealt.schema), "block-classes")
    texts = scratch.written(fetch(scratch.written(work.select("class").distinct(), "block-ids")), "block-texts")
    return work.join(texts, "class").repartition(tasks, *meeting).groupBy(*meeting).applyInArrow(compare, "a long, b long")


def _few(ids: DataFrame) -> DataFrame:
    """`ids`, to be broadcast if they are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles (of `words` words), component_id, kept."""
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    sketches = scratch.written(sketched(texts, words), "sketches")
    with_set = sketches.where("n_shingles > 0 and doc_id is not null")
    # the documents of a class are equal sets, so any one's sketch is the class's
    classes = with_set.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "sketch"), "doc_id").alias("_"), F.count("*").alias("_n"))
    classes = scratch.written(classes.select("digest", "_n", "_.*", F.monotonically_increasing_id().alias("class")), "classes")
    mixed = scratch.written(with_set.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).where("_low != _high").select("doc_id"), "mixed-ids")
    mixed_ids = bool(mixed.limit(1).count())

    def fetch(wanted: DataFrame) -> DataFrame:
        return class_texts(wanted, classes, texts, words, mixed_ids, scratch)

    def checked(pairs: DataFrame) -> DataFrame:
        return scratch.written(verified(scratch.written(likely(pairs, classes), "likely-pairs"), fetch, scratch, words), "links")

    stars = scratch.written(hubbed(banded(classes), scratch).select(F.col("hub").alias("star"), "class").distinct(), "stars")
    tried = scratch.written(_once(stars.withColumnRenamed("star", "hub")), "pairs")
    links = checked(tried)
    if mixed_ids:
        own = with_set.join(_few(mixed), "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "class"), "digest")
        first = own.groupBy("doc_id").agg(F.min("class").alias("b"))
        links = links.union(scratch.written(own.join(first, "doc_id").where("class != b").select(F.col("class").alias("a"), "b"), "links"))
    joined = components(links, scratch)

    open_ = _open_stars(stars, joined, scratch)
    for _ in range(HUB_ROUNDS):
        if not open_.where(F.col("n") > LARGE).limit(1).count():
            break
        pairs = scratch.written(_once(open_.where("component != hub_component")).join(tried, ["low", "high"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = links.union(checked(pairs))
        joined = components(links, scratch)
        open_ = _open_stars(open_.where("class != hub").select("star", "class"), joined, scratch)
    if open_.limit(1).count():
        found = scratch.written(block_links(open_, classes, fetch, scratch, words), "links")
        if found.limit(1).count():
            joined = components(links.union(found), scratch)
    # of every class its component's least id, given back to the documents
    named = classes.join(joined, F.col("class") == F.col("node"), "left").select("digest", "_n", "doc_id", F.coalesce("component", "class").alias("component"))
    named = scratch.written(named, "class-components")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n"))
    named = given_back(named.withColumnRenamed("_n", "_size"), scratch.written(least, "least-ids"), ["component"], scratch)
    named = scratch.written(named.select("digest", F.col("_size").alias("_n"), "component_id"), "class-ids")
    rows = given_back(with_set.select("doc_id", "n_shingles", "digest"), named, ["digest"], scratch).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = kept.written(rows.unionByName(alone), "near-groups")
    scratch.drop()
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir), words=4)
