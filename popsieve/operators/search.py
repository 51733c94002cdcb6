"""Similarity search: full scans and threshold searches of one or many queries.

Queries come from the caller as 0/1 vectors and are few next to the database. A threshold search lists, for each
query, the on-bit counts that can match (exactly, on the driver). One query becomes literals; many become
broadcast blocks of (query, bounds of on-bits, words) that every row is held against; queries that are rows
themselves are broadcast likewise if they are few, and meet it by an equi-join on on-bits if not. The database is scanned once, its partitions pruned by literal on-bits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import centi_score, common, intersection, ones, tanimoto, union, within, word_names
from ..functions.text import sanitized
from ..plans.bounds import allowed, may_match
from .database import BROADCAST_PARTS, Database, few

#: Bytes of queries that are broadcast at once; more go in several blocks.
BROADCAST_BYTES = 16 << 20
#: Times that much that bit lists of queries may take to be broadcast.
LIST_BLOCKS = 4
#: Words of a vector up to which on-bit bounds don't pay.
FEW_WORDS = 4
#: Distributed queries from which their join is salted, and the salts.
SALTED_QUERIES, SALTS = 100_000, 16


def packed(queries, bits: int) -> tuple[list[list[int]], list[int]]:
    """Words (signed 64-bit) and on-bits of one vector or a matrix of vectors of 0 and 1."""
    matrix = np.asarray(queries)
    if matrix.ndim not in (1, 2):
        raise ValueError("queries must be a vector or a matrix")
    matrix = np.atleast_2d(matrix)
    if matrix.shape[1] != bits:
        raise ValueError(f"queries have {matrix.shape[1]} bits, the database {bits}")
    if not np.isin(matrix, (0, 1)).all():
        raise ValueError("queries must hold 0 and 1 alone")
    padded = np.zeros((len(matrix), len(word_names(bits)) * 64), np.uint8)
    padded[:, :bits] = matrix
    words = np.packbits(padded, axis=1).view(">i8").astype(np.int64)
    return words.tolist(), matrix.sum(1).astype(int).tolist()


def from_on_bits(indices: Sequence[Sequence[int]], bits: int) -> np.ndarray:
    """Vectors from lists of on-bit indices."""
    out = np.zeros((len(indices), bits), np.uint8)
    for row, places in zip(out, indices, strict=True):
        row[list(places)] = 1
    return out


def _words(prefix: str, bits: int) -> list:
    return [F.col(w) for w in word_names(bits, prefix)]


def get_sim_scores(db: Database, query) -> DataFrame:
    """chunk_idx, position, score (centi) of every row; a map-only stage. One query only."""
    words, ones_q = packed(query, db.bits)
    if len(words) != 1:
        raise ValueError("a full scan takes one query")
    inter = intersection(_words("w", db.bits), [F.lit(w).cast("long") for w in words[0]])
    return db.fp.select("chunk_idx", "position", centi_score(inter, union(inter, F.col("onbits"), F.lit(ones_q[0]))).alias("score"))


def global_scores(db: Database, query) -> DataFrame:
    """(gid, score) of every row: a full scan in the database's global numbering."""
    parts = few(db.catalog.select("chunk_idx", "start"), BROADCAST_PARTS)
    return get_sim_scores(db, query).join(parts, "chunk_idx").select((F.col("start") + F.col("position")).alias("gid"), "score")


def raw_scores(db: Database, query) -> np.ndarray:
    """A byte a row in global order, on the driver; for databases that fit there (see write_raw_scores for others)."""
    table = global_scores(db, query).toArrow().sort_by("gid")
    return table.column("score").to_numpy().astype(np.uint8)


def get_sim_compounds_single_query(db: Database, query, lower: float = 0.0, upper: float = 1.0, return_smiles: bool = False) -> DataFrame:
    """chunk_idx, position, inter, denom, score (centi), tanimoto (float) of the rows within the bounds."""
    words, ones_q = packed(query, db.bits)
    if len(words) != 1:
        raise ValueError("takes one query")
    onbits = [a for _, a in allowed(ones_q, db.bits, lower, upper)]
    inter = intersection(_words("w", db.bits), [F.lit(w).cast("long") for w in words[0]])
    rows = db.fp.where(_onbits_in(onbits)).withColumn("inter", inter).where(within(F.col("inter"), F.col("onbits"), F.lit(ones_q[0]), lower, upper))
    return _scored(db, rows.withColumn("ones_q", F.lit(ones_q[0])), ["chunk_idx", "position"], return_smiles, _onbits_in(onbits))


def _onbits_in(onbits: list[int]):
    """A literal predicate for partition pruning; the counts that may match are a range, or nearly."""
    if not onbits:
        return F.lit(False)
    low, high = min(onbits), max(onbits)
    return F.col("onbits").between(low, high) if high - low + 1 == len(set(onbits)) else F.col("onbits").isin(sorted(set(onbits)))


def _scored(db: Database, rows: DataFrame, keys: list[str], return_smiles: bool, onbits=None) -> DataFrame:
    denom = union(F.col("inter"), F.col("onbits"), F.col("ones_q"))
    out = rows.withColumn("denom", denom).select(*keys, "inter", "denom", centi_score(F.col("inter"), F.col("denom")).alias("score"), tanimoto(F.col("inter"), F.col("denom")).alias("tanimoto"))
    return db.lookup(out, onbits) if return_smiles else out


def query_relation(db: Database, queries: Sequence, lower: float, upper: float) -> list[tuple[DataFrame, list[int]]]:
    """(query_idx, ones_q, first, last, q-words), a row a query, and the on-bit counts that any may match: in as many
    relations as it takes to keep each within BROADCAST_BYTES. first and last bound the on-bits that the query may match."""
    words, ones_q = packed(queries, db.bits)
    names = word_names(db.bits, "q")
    matrix = np.array(words, np.int64).reshape(len(words), len(names))
    ranges = {q: [a for a in range(db.bits + 1) if may_match(a, q, db.bits, lower, upper)] for q in set(ones_q)}
    kept = [k for k, q in enumerate(ones_q) if ranges[q]]
    most = max(1, BROADCAST_BYTES // (8 * len(names) + 48))
    out = []
    for at in range(0, max(1, len(kept)), most):
        some = np.array(kept[at : at + most], np.int32)
        sizes = [ones_q[k] for k in some]
        columns = [some, sizes, [ranges[q][0] for q in sizes], [ranges[q][-1] for q in sizes]]
        table = pa.table([*(pa.array(c, pa.int32()) for c in columns), *(pa.array(matrix[some, k]) for k in range(len(names)))], names=["query_idx", "ones_q", "first", "last", *names])
        out.append((db.fp.sparkSession.createDataFrame(table), sorted({a for q in set(sizes) for a in ranges[q]})))
    return out


def _hit(db: Database, inter, lower: float, upper: float):
    """Whether a row and a query beside it (ones_q, first, last, q-words) are within the bounds."""
    hit = within(inter, F.col("onbits"), F.col("ones_q"), lower, upper)
    if len(word_names(db.bits)) > FEW_WORDS or lower <= 0:  # a query without bits, too, has no hits
        hit = F.col("onbits").between(F.col("first"), F.col("last")) & hit
    return hit


def get_sim_compounds_multi_query(db: Database, queries, lower: float = 0.0, upper: float = 1.0, return_smiles: bool = False, max_hits_per_chunk: int | None = None) -> DataFrame:
    """chunk_idx, query_idx, position, inter, denom, score, tanimoto of all (query, row) within the bounds.

    The given queries, in blocks, are held against all rows in generated code, by the integer threshold, and where
    vectors are wide by their on-bit bounds before that (up to FEW_WORDS words, counting shared bits costs no more than
    the bounds; a hash join on on-bits, of which there are few, costs more than either). max_hits_per_chunk makes a chunk of more hits an error; by default hits are unbounded.
    """
    parts, counts = [], []
    for relation, onbits in query_relation(db, queries, lower, upper):
        inter = intersection(_words("w", db.bits), _words("q", db.bits))
        rows = db.fp.where(_onbits_in(onbits)).join(F.broadcast(relation), _hit(db, inter, lower, upper)).withColumn("inter", inter)
        parts.append(_scored(db, rows, ["chunk_idx", "query_idx", "position"], False))
        counts += onbits
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if max_hits_per_chunk is not None:
        if max_hits_per_chunk < 1:
            raise ValueError("max_hits_per_chunk must be positive")
        worst = out.groupBy("chunk_idx").count().where(F.col("count") > max_hits_per_chunk).limit(1).collect()
        if worst:
            raise MemoryError(f"chunk {worst[0]['chunk_idx']} has {worst[0]['count']} hits, more than {max_hits_per_chunk}")
    return db.lookup(out, _onbits_in(sorted(set(counts)))) if return_smiles else out


def get_sim_compounds_of_rows(db: Database, queries: DataFrame, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """chunk_idx, query_id, position, inter, denom, score, tanimoto of all (query, row) within the bounds.

    Queries are rows (query_id, words w0, w1 ...), as many as there are. Up to BROADCAST_BYTES of them are broadcast and held
    against every row as given vectors are, so the database doesn't shuffle. Beyond that both meet by their on-bits, which
    are few and uneven keys, so each query goes to one of SALTS salts of its counts and each row to all of them where queries are many."""
    names = word_names(db.bits)
    inter = intersection(_words("w", db.bits), _words("q", db.bits))
    side = queries.select("query_id", ones([F.col(n) for n in names]).cast("int").alias("ones_q"), *(F.col(n).alias(q) for n, q in zip(names, word_names(db.bits, "q"), strict=True)))
    keys = ["chunk_idx", "query_id", "position"]
    matching = {q: [a for a in range(db.bits + 1) if may_match(a, q, db.bits, lower, upper)] for q in range(db.bits + 1)}
    most = BROADCAST_BYTES // (8 * len(names) + 48)
    n, least, greatest = side.limit(max(most, SALTED_QUERIES) + 1).agg(F.count("*"), F.min("ones_q"), F.max("ones_q")).first()
    if n <= most:
        limits = side.sparkSession.createDataFrame([(q, found[0], found[-1]) for q, found in matching.items() if found], "ones_q int, first int, last int")
        onbits = sorted({a for q in range(least or 0, (greatest or 0) + 1) for a in matching[q]})
        rows = db.fp.where(_onbits_in(onbits)).join(F.broadcast(side.join(F.broadcast(limits), "ones_q")), _hit(db, inter, lower, upper))
        return _scored(db, rows.withColumn("inter", inter), keys, False)
    grid = F.broadcast(side.sparkSession.createDataFrame([(q, a) for q, found in matching.items() for a in found], "ones_q int, onbits int"))
    side, fp = side.join(grid, "ones_q"), db.fp
    if n > SALTED_QUERIES:
        side = side.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
        fp = fp.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = fp.join(side, [c for c in ("onbits", "_salt") if c in side.columns]).withColumn("inter", inter)
    return _scored(db, rows.where(within(F.col("inter"), F.col("onbits"), F.col("ones_q"), lower, upper)), keys, False)


def bit_list(bits: int, prefix: str = "w"):
    """The numbers of a row's set bits, as an array."""
    lists = []
    for k, word in enumerate(_words(prefix, bits)):
        places = F.sequence(F.lit(64 * k), F.lit(min(64 * k + 64, bits) - 1))
        lists.append(_set_places(places, word, k))
    return F.concat(*lists)


def _set_places(places, word, k: int):
    return F.filter(places, lambda i: F.call_function("getbit", word, (F.lit(64 * k + 63) - i).cast("int")) == 1)


def _listed(bits: int, onbits, lower: float, upper: float):
    """The numbers of a row's first set bits, as many as it takes to hold one of those that it shares with any vector within the
    bounds: all but the least number of shared bits, and one."""
    low, _, den = common(lower, upper)
    counts = []
    for n in range(bits + 1):
        fewest = next((a for a in range(n + 1) if may_match(a, n, bits, lower, upper)), None)
        counts.append(0 if fewest is None else n + 1 - max(1, -(-low * (n + fewest) // (den + low))))
    return F.slice(bit_list(bits), F.lit(1), F.element_at(F.array(*map(F.lit, counts)), onbits + 1))


def _before(word, bit, k: int):
    """The bits of word k of a vector that come before `bit`."""
    inside = F.when(bit <= 64 * k, 0).when(bit < 64 * k + 64, F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64 * k + 64) - bit)).otherwise(-1)
    return word.bitwiseAND(inside.cast("long"))


def get_sim_compounds_by_bits(db: Database, queries: DataFrame, lower: float, upper: float = 1.0) -> DataFrame:
    """The hits of get_sim_compounds_of_rows() by inverted bit lists: rows and queries meet at the bits that both have, each
    pair is taken at the first of them alone, and its shared bits are counted there, so pairs are neither grouped nor shuffled.
    Of a vector only the first bits are listed (see _listed). For sparse vectors, where most pairs share none; pairs that share none
    can't be found, so lower must be positive. Lists of over LIST_BLOCKS times BROADCAST_BYTES are salted, as bits are few keys."""
    if lower <= 0:
        raise ValueError("bit lists need a positive lower bound")
    names = word_names(db.bits)
    earlier = word_names(db.bits, "e")
    side = queries.select("query_id", ones([F.col(n) for n in names]).cast("int").alias("ones_q"), *names)
    side = side.select("*", F.explode(_listed(db.bits, F.col("ones_q"), lower, upper)).alias("bit"))
    side = side.select("query_id", "ones_q", "bit", *(F.col(n).alias(q) for n, q in zip(names, word_names(db.bits, "q"), strict=True)), *(_before(F.col(n), F.col("bit"), k).alias(e) for k, (n, e) in enumerate(zip(names, earlier, strict=True))))
    tasks = int(db.fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are short next to their work, and adaptive execution deals by bytes
    rows = db.fp.repartition(tasks, "chunk_idx", "position").select("chunk_idx", "position", "onbits", *names, F.explode(_listed(db.bits, F.col("onbits"), lower, upper)).alias("bit"))
    keys = ["bit"]
    if side.count() * (16 * len(names) + 48) <= LIST_BLOCKS * BROADCAST_BYTES:
        side = F.broadcast(side)
    else:
        side = side.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
        rows, keys = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["bit", "_salt"]
    first = F.lit(0).cast("long")
    for n, e in zip(names, earlier, strict=True):
        first = first.bitwiseOR(F.col(n).bitwiseAND(F.col(e)))
    inter = intersection(_words("w", db.bits), _words("q", db.bits))
    pairs = rows.join(side, keys).where((first == 0) & within(inter, F.col("onbits"), F.col("ones_q"), lower, upper)).withColumn("inter", inter)
    return _scored(db, pairs, ["chunk_idx", "query_id", "position"], False)


def get_sim_compounds_multi_query_with_scores(db: Database, queries, lower: float, upper: float, smiles_output_path: str | None) -> DataFrame:
    """Two queries or more; the hits with payload, written to smiles_output_path as TSV files with a header."""
    if np.asarray(queries).ndim != 2 or len(queries) < 2:
        raise ValueError("takes two queries or more")
    if lower > upper:
        raise ValueError("lower is above upper")
    if not smiles_output_path:
        raise ValueError("smiles_output_path is required")
    out = hit_rows(get_sim_compounds_multi_query(db, queries, lower, upper, return_smiles=True))
    write_hits(out, smiles_output_path)
    return out


def hit_rows(hits: DataFrame) -> DataFrame:
    """The columns of a hit file, their cells sanitized."""
    return hits.select("chunk_idx", "query_idx", "position", "score", sanitized(F.col("smiles")).alias("smiles"), sanitized(F.col("compound_id")).alias("compound_id"))


def write_hits(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def get_sim_compounds(db: Database, queries, lower: float = 0.0, upper: float = 1.0, return_smiles: bool = False) -> DataFrame:
    """One vector, or a matrix of one row: the single-query search; else the multi-query one."""
    matrix = np.asarray(queries)
    if matrix.ndim == 1 or (matrix.ndim == 2 and len(matrix) == 1):
        return get_sim_compounds_single_query(db, matrix, lower, upper, return_smiles)
    return get_sim_compounds_multi_query(db, matrix, lower, upper, return_smiles)


def nested_hits(hits: DataFrame) -> DataFrame:
    """(chunk_idx, query_idx, positions ascending) of flat hits."""
    return hits.groupBy("chunk_idx", "query_idx").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def top_k(db: Database, query, k: int) -> DataFrame:
    """The k best rows of a full scan, ties by chunk and position (an extension)."""
    return get_sim_scores(db, query).orderBy(F.desc("score"), "chunk_idx", "position").limit(k)
