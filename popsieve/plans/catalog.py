"""The registered queries and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import ingest, search
from ..sources.delimited import guess_format_column
from ..sources.tables import resume
from . import files, standins
from .bounds import may_match

ONE = [7]
#: Queries of the multi-query searches: every row whose id is divisible by this, numbered by id / EVERY.
EVERY = 50

_BITS = """bits AS (SELECT DISTINCT o_custkey AS k, l_partkey % 128 AS bit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ones AS (SELECT k, count(*) AS onbits FROM bits GROUP BY k),
fp AS (SELECT CAST(c_nationkey AS BIGINT) AS chunk_id, k, onbits, c_name, c_mktsegment,
              row_number() OVER (PARTITION BY c_nationkey, onbits ORDER BY k) - 1 AS position
       FROM ones JOIN customer ON c_custkey = k),
sizes AS (SELECT chunk_id, onbits, count(*) AS size FROM fp GROUP BY chunk_id, onbits),
manifest AS (SELECT row_number() OVER (ORDER BY chunk_id, onbits) - 1 AS chunk_idx, chunk_id, onbits, size,
                    sum(size) OVER (ORDER BY chunk_id, onbits) - size AS start FROM sizes),
db AS (SELECT chunk_idx, position, fp.k, fp.onbits, c_name, c_mktsegment, start FROM fp JOIN manifest USING (chunk_id, onbits))"""


def _pairs(where: str) -> str:
    """Shared bits of every (query, row), rows without any included."""
    return f"""WITH {_BITS},
q AS (SELECT k AS query_key, onbits AS ones_q FROM ones WHERE {where}),
shared AS (SELECT a.k AS query_key, b.k, count(*) AS n FROM bits a JOIN bits b ON a.bit = b.bit WHERE a.k IN (SELECT query_key FROM q) GROUP BY a.k, b.k),
pairs AS (SELECT query_key, query_key // 50 AS query_idx, ones_q, db.*,
                 coalesce(n, 0) AS inter, ones_q + onbits - coalesce(n, 0) AS denom
          FROM q CROSS JOIN db LEFT JOIN shared USING (query_key, k))"""


_SCORE = "CAST((200 * inter + denom) // (2 * denom) AS INTEGER) AS score"
_MANY, _SINGLE = "k % 50 = 0", "k = 7"


def _hit(num: int, den: int, high: int | None = None) -> str:
    high = den if high is None else high
    return f"inter * ({den} + {num}) >= {num} * (ones_q + onbits) AND inter * ({den} + {high}) <= {high} * (ones_q + onbits)"


def _multi(spark: SparkSession, sf_dir: str, lower: float, smiles: bool = False) -> DataFrame:
    rows = standins.basket(spark, sf_dir)
    db = standins.Database.build(rows, 128)
    hits = search.get_sim_compounds_of_rows(db, _queries(rows).withColumn("query_id", F.call_function("div", F.col("query_id"), F.lit(EVERY))), lower).withColumnRenamed("query_id", "query_idx")
    return db.lookup(hits) if smiles else hits


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("line_no") % EVERY == 0).withColumnRenamed("line_no", "query_id")


def _one(spark: SparkSession, sf_dir: str, lower: float, upper: float = 1.0) -> DataFrame:
    rows = standins.basket(spark, sf_dir)
    return search.get_sim_compounds(standins.Database.build(rows, 128), standins.vectors(rows, 128, ONE), lower, upper)


def _every(rows: DataFrame, bits: int, lower: float) -> DataFrame:
    return search.get_sim_compounds_of_rows(standins.Database.build(rows, bits), _queries(rows), lower).select("chunk_idx", "query_id", "position", "inter", "denom", "score")


def threshold_every50(spark, sf_dir):
    return _every(standins.basket(spark, sf_dir), 128, 0.2)


def threshold_bit_lists(spark, sf_dir):
    """The same hits at 0.3 by inverted bit lists."""
    rows = standins.basket(spark, sf_dir)
    return search.get_sim_compounds_by_bits(standins.Database.build(rows, 128), _queries(rows), 0.3).select("chunk_idx", "query_id", "position", "inter", "denom", "score")


def emb64_every50(spark, sf_dir):
    return _every(standins.signs(spark, sf_dir), 64, 0.4)


def payload_every_row(spark, sf_dir):
    db = standins.basket_db(spark, sf_dir)
    return db.lookup(db.fp.select("chunk_idx", "position")).select("chunk_idx", "position", "smiles", "compound_id")


def fp_build(spark, sf_dir):
    rows = standins.basket(spark, sf_dir)
    halves = []
    for k in range(2):
        word = F.col(f"w{k}")
        halves += [F.shiftrightunsigned(word, 32).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"h{2 * k}"), word.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"h{2 * k + 1}")]
    return rows.select(F.col("line_no").alias("k"), similarity.ones([F.col("w0"), F.col("w1")]).cast("long").alias("onbits"), *halves)


def manifest_onbits(spark, sf_dir):
    catalog = standins.basket_db(spark, sf_dir).catalog
    return catalog.select("chunk_idx", "chunk_id", F.col("onbits").cast("long").alias("onbits"), "size", "start")


def scan_scores_single(spark, sf_dir):
    rows = standins.basket(spark, sf_dir)
    return search.get_sim_scores(standins.Database.build(rows, 128), standins.vectors(rows, 128, ONE))


def threshold_single(spark, sf_dir):
    return _one(spark, sf_dir, 0.2).select("chunk_idx", "position", "inter", "denom", "score")


def threshold_single_upper_band(spark, sf_dir):
    return _one(spark, sf_dir, 0.1, 0.25).select("chunk_idx", "position", "inter", "denom", "score")


def threshold_multi(spark, sf_dir):
    return _multi(spark, sf_dir, 0.2).select("chunk_idx", F.col("query_idx").cast("long").alias("query_idx"), "position")


def threshold_multi_scored(spark, sf_dir):
    return _multi(spark, sf_dir, 0.3).select("chunk_idx", F.col("query_idx").cast("long").alias("query_idx"), "position", "inter", "denom", "score")


def threshold_multi_payload(spark, sf_dir):
    return search.hit_rows(_multi(spark, sf_dir, 0.3, smiles=True)).withColumn("query_idx", F.col("query_idx").cast("long"))


def hits_per_query(spark, sf_dir):
    hits = _multi(spark, sf_dir, 0.25)
    return hits.groupBy("query_idx").agg(F.count("*").alias("hits"), F.sum("score").alias("score_sum")).select(F.col("query_idx").cast("long").alias("query_idx"), "hits", "score_sum")


def nested_positions(spark, sf_dir):
    nested = search.nested_hits(_multi(spark, sf_dir, 0.25))
    return nested.select("chunk_idx", F.col("query_idx").cast("long").alias("query_idx"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def top_k(spark, sf_dir):
    rows = standins.basket(spark, sf_dir)
    return search.top_k(standins.Database.build(rows, 128), standins.vectors(rows, 128, ONE), 50)


def database_size(spark, sf_dir):
    catalog = standins.basket_db(spark, sf_dir).catalog
    return catalog.agg(F.sum("size").alias("rows"), F.max("size").alias("largest"), F.count("*").alias("parts"))


def prune_shortlist(spark, sf_dir):
    """P1 to P3 over the whole grid of (query on-bits, row on-bits) of 64 bits at [0.3, 0.8]."""
    rows = [(q, a) for q in range(65) for a in range(65) if may_match(a, q, 64, 0.3, 0.8)]
    return spark.createDataFrame(rows, "ones_q long, onbits long")


def global_to_chunk(spark, sf_dir):
    db = standins.basket_db(spark, sf_dir)
    return db.global_to_chunk_position(spark.range(len(db)).withColumnRenamed("id", "gid"))


def payload_lookup(spark, sf_dir):
    """Every row by its place from its part's end."""
    db = standins.basket_db(spark, sf_dir)
    wanted = db.fp.select("chunk_idx", "position").join(F.broadcast(db.catalog.select("chunk_idx", "size")), "chunk_idx").select("chunk_idx", (F.col("position") - F.col("size")).alias("position"))
    return db.lookup(wanted).select("chunk_idx", "position", "smiles", "compound_id")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("chunk_id"), F.col("event_id").alias("line_no"), "event_type")


def dedup_consecutive_id(spark, sf_dir):
    return ingest.dedup_consecutive(_events(spark, sf_dir), "event_type")


def dedup_keep_first(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("chunk_id"), F.col("doc_id").alias("line_no"), "text")
    return ingest.dedup_keep_first(docs, "text").select("chunk_id", "line_no", F.length("text").cast("long").alias("n"))


def keep_first_counters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("chunk_id"), F.col("doc_id").alias("line_no"), F.col("text").alias("smiles"))
    valid = docs.where(F.octet_length("smiles") <= 2000)
    return ingest.counters(docs, valid, ingest.dedup_keep_first(valid, "smiles"))


def short_id(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "zInC").when(F.col("c_custkey") % 3 == 1, "ZINC").otherwise(""), F.repeat(F.lit("0"), (F.col("c_custkey") % 13).cast("int")), F.col("c_custkey").cast("string")).alias("id"))
    return ids.select("c_custkey", text.short_id(F.col("id")).alias("short_id"), text.has_zinc_prefix(F.col("id")).alias("prefixed"))


def sanitize_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(text.sanitized(F.col("text"))).alias("h"))


def generated_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return docs.select("c_custkey", text.generated_id(F.col("c_nationkey"), F.col("c_custkey") + 1).alias("id"))


def length_cap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.repeat("p_type", 8).alias("smiles"))
    return docs.where(text.fits(F.col("smiles"))).select("p_partkey")


def zinc_download_filter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).alias("chunk_id"), F.col("o_orderkey").alias("line_no"), F.concat_ws("\t", "o_orderstatus", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ZINC").otherwise(""), F.substring("o_orderpriority", 1, 1)), "o_orderpriority").alias("line"))
    return ingest.download_filter(rows)


def ref_pack_unpack(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 8192).alias("frame"), (F.col("l_orderkey") % 524288).alias("row"))
    ref = similarity.reference(F.col("frame"), F.col("row"))
    return rows.select(ref.alias("ref")).distinct().select("ref", similarity.frame_of(F.col("ref")).alias("frame"), similarity.row_of(F.col("ref")).alias("row"))


def onbits_from_name(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("x.y/chunk_0_onbits_9_onbits_"), F.col("p_size").cast("string"), F.lit(".npy")).alias("path"))
    return rows.select("p_partkey", similarity.onbits_from_name(F.col("path")).cast("long").alias("onbits"))


def format_guess(spark, sf_dir):
    ends = F.array(*map(F.lit, [".csv", ".CSV.gz", ".tsv.bz2", ".tab.zst", ".csv.bgzf", ".smi", ".tsv"]))
    paths = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.explode(ends).alias("end")).select(F.concat("n_name", "end").alias("path"))
    return paths.select("path", guess_format_column(F.col("path")).alias("format"))


def resume_semi_anti(spark, sf_dir):
    chunks = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("chunk_id"))
    listed = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % 30).alias("chunk_id"))
    again, missing = resume(chunks, listed)
    return again.withColumn("kind", F.lit("redo")).union(missing.withColumn("kind", F.lit("missing")))


def emb64_threshold(spark, sf_dir):
    """By a matrix of vectors that the caller has."""
    rows = standins.signs(spark, sf_dir)
    keys = sorted(r["query_id"] for r in _queries(rows).select("query_id").collect())
    hits = search.get_sim_compounds_multi_query(standins.Database.build(rows, 64), standins.vectors(rows, 64, keys), 0.4)
    return hits.select("chunk_idx", F.col("query_idx").cast("long").alias("query_idx"), "position", "inter", "denom", "score")


def score_order(spark, sf_dir):
    """Rows of the full scan in global order: id, score."""
    rows = standins.basket(spark, sf_dir)
    db = standins.Database.build(rows, 128)
    scores = search.get_sim_scores(db, standins.vectors(rows, 128, ONE))
    return scores.join(F.broadcast(db.catalog.select("chunk_idx", "start")), "chunk_idx").select((F.col("start") + F.col("position")).alias("gid"), "score")


QUERIES = {
    "fp_build_basket128": fp_build,
    "manifest_onbits": manifest_onbits,
    "scan_scores_single": scan_scores_single,
    "scan_scores_global_order": score_order,
    "threshold_single": threshold_single,
    "threshold_single_upper_band": threshold_single_upper_band,
    "threshold_multi": threshold_multi,
    "threshold_multi_scored": threshold_multi_scored,
    "threshold_multi_payload": threshold_multi_payload,
    "hits_per_query": hits_per_query,
    "nested_positions": nested_positions,
    "top_k": top_k,
    "database_size": database_size,
    "prune_shortlist": prune_shortlist,
    "global_to_chunk": global_to_chunk,
    "payload_lookup": payload_lookup,
    "dedup_consecutive_id": dedup_consecutive_id,
    "dedup_keep_first": dedup_keep_first,
    "keep_first_counters": keep_first_counters,
    "short_id": short_id,
    "sanitize_id": sanitize_id,
    "generated_id": generated_id,
    "length_cap": length_cap,
    "zinc_download_filter": zinc_download_filter,
    "ref_pack_unpack": ref_pack_unpack,
    "onbits_from_name": onbits_from_name,
    "format_guess": format_guess,
    "resume_semi_anti": resume_semi_anti,
    "emb64_threshold": emb64_threshold,
    "threshold_every50": threshold_every50,
    "threshold_bit_lists": threshold_bit_lists,
    "emb64_every50": emb64_every50,
    "payload_every_row": payload_every_row,
}

_EMB = """WITH bits AS (SELECT vec_id AS k, label, i - 1 AS bit FROM embeddings CROSS JOIN range(1, 65) r(i) WHERE embedding[i] > 0),
ones AS (SELECT k, label, count(*) AS onbits FROM bits GROUP BY k, label),
fp AS (SELECT label AS chunk_id, k, onbits, row_number() OVER (PARTITION BY label, onbits ORDER BY k) - 1 AS position FROM ones),
manifest AS (SELECT row_number() OVER (ORDER BY chunk_id, onbits) - 1 AS chunk_idx, chunk_id, onbits FROM fp GROUP BY chunk_id, onbits),
shared AS (SELECT a.k AS query_key, b.k, count(*) AS inter FROM bits a JOIN bits b USING (bit) WHERE a.k % 50 = 0 GROUP BY a.k, b.k),
pairs AS (SELECT chunk_idx, query_key, query_key // 50 AS query_idx, position, inter, q.onbits AS ones_q, fp.onbits, q.onbits + fp.onbits - inter AS denom
          FROM shared JOIN fp USING (k) JOIN manifest USING (chunk_id, onbits) JOIN ones q ON q.k = query_key)"""

SQL = {
    "fp_build_basket128": f"""WITH {_BITS} SELECT k, count(*) AS onbits, {", ".join(f"coalesce(bit_or(CASE WHEN bit // 32 = {h} THEN CAST(1 AS BIGINT) << CAST(31 - bit % 32 AS INTEGER) END), 0) AS h{h}" for h in range(4))} FROM bits JOIN customer ON c_custkey = k GROUP BY k""",
    "manifest_onbits": f"WITH {_BITS} SELECT chunk_idx, chunk_id, onbits, size, CAST(start AS BIGINT) AS start FROM manifest",
    "scan_scores_single": f"{_pairs(_SINGLE)} SELECT chunk_idx, position, {_SCORE} FROM pairs",
    "scan_scores_global_order": f"{_pairs(_SINGLE)} SELECT CAST(start + position AS BIGINT) AS gid, {_SCORE} FROM pairs",
    "threshold_single": f"{_pairs(_SINGLE)} SELECT chunk_idx, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(1, 5)}",
    "threshold_single_upper_band": f"{_pairs(_SINGLE)} SELECT chunk_idx, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(2, 20, 5)}",
    "threshold_multi": f"{_pairs(_MANY)} SELECT chunk_idx, query_idx, position FROM pairs WHERE {_hit(1, 5)}",
    "threshold_multi_scored": f"{_pairs(_MANY)} SELECT chunk_idx, query_idx, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(3, 10)}",
    "threshold_multi_payload": f"{_pairs(_MANY)} SELECT chunk_idx, query_idx, position, {_SCORE}, c_name AS smiles, c_mktsegment AS compound_id FROM pairs WHERE {_hit(3, 10)}",
    "hits_per_query": f"{_pairs(_MANY)} SELECT query_idx, count(*) AS hits, CAST(sum((200 * inter + denom) // (2 * denom)) AS BIGINT) AS score_sum FROM pairs WHERE {_hit(1, 4)} GROUP BY query_idx",
    "nested_positions": f"{_pairs(_MANY)} SELECT chunk_idx, query_idx, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM pairs WHERE {_hit(1, 4)} GROUP BY chunk_idx, query_idx",
    "top_k": f"{_pairs(_SINGLE)} SELECT chunk_idx, position, {_SCORE} FROM pairs ORDER BY score DESC, chunk_idx, position LIMIT 50",
    "database_size": f"WITH {_BITS} SELECT CAST(sum(size) AS BIGINT) AS \"rows\", max(size) AS largest, count(*) AS parts FROM manifest",
    "prune_shortlist": """WITH g AS (SELECT CAST(q AS BIGINT) AS ones_q, CAST(a AS BIGINT) AS onbits FROM range(65) x(q) CROSS JOIN range(65) y(a)),
t AS (SELECT *, greatest(0, onbits + ones_q - 64) AS least_i FROM g)
SELECT ones_q, onbits FROM t WHERE ones_q > 0 AND least(ones_q, onbits) * 10 >= 3 * greatest(ones_q, onbits) AND least_i * 10 <= 8 * (onbits + ones_q - least_i)""",
    "global_to_chunk": f"WITH {_BITS} SELECT CAST(start + position AS BIGINT) AS gid, chunk_idx, position FROM db",
    "payload_lookup": f"WITH {_BITS} SELECT chunk_idx, position - count(*) OVER (PARTITION BY chunk_idx) AS position, c_name AS smiles, c_mktsegment AS compound_id FROM db",
    "dedup_consecutive_id": "SELECT user_id % 50 AS chunk_id, event_id AS line_no, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id % 50 ORDER BY event_id)",
    "dedup_keep_first": "SELECT source AS chunk_id, doc_id AS line_no, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1",
    "keep_first_counters": "SELECT source AS chunk_id, count(*) AS \"read\", count(DISTINCT CASE WHEN octet_length(encode(text)) <= 2000 THEN text END) AS written, count(*) FILTER (octet_length(encode(text)) > 2000) AS skipped, count(*) FILTER (octet_length(encode(text)) <= 2000) - count(DISTINCT CASE WHEN octet_length(encode(text)) <= 2000 THEN text END) AS duplicates FROM documents GROUP BY source",
    "short_id": "WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'zInC' WHEN 1 THEN 'ZINC' ELSE '' END || repeat('0', c_custkey % 13) || c_custkey AS id FROM customer), s AS (SELECT c_custkey, id, CASE WHEN lower(id[1:4]) = 'zinc' THEN id[5:] ELSE id END AS s FROM t) SELECT c_custkey, CASE WHEN length(s) BETWEEN 1 AND 12 THEN s END AS short_id, lower(id[1:4]) = 'zinc' AS prefixed FROM s",
    "sanitize_id": "SELECT doc_id, md5(translate(text, chr(9) || chr(13) || chr(10), '   ')) AS h FROM documents",
    "generated_id": "SELECT c_custkey, 'mol_' || c_nationkey || '_' || (c_custkey + 1) AS id FROM customer",
    "length_cap": "SELECT p_partkey FROM part WHERE length(repeat(p_type, 8)) <= 162",
    "zinc_download_filter": "SELECT o_custkey % 20 AS chunk_id, o_orderkey AS line_no, o_orderstatus AS smiles, CASE WHEN o_orderkey % 2 = 0 THEN 'ZINC' ELSE '' END || o_orderpriority[1:1] AS compound_id FROM orders QUALIFY o_orderpriority[1:1] IS DISTINCT FROM lag(o_orderpriority[1:1]) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey)",
    "ref_pack_unpack": "SELECT DISTINCT (l_suppkey % 8192) * 524288 + l_orderkey % 524288 AS ref, l_suppkey % 8192 AS frame, l_orderkey % 524288 AS row FROM lineitem",
    "onbits_from_name": "SELECT p_partkey, CAST(p_size AS BIGINT) AS onbits FROM part",
    "format_guess": "SELECT n_name || e AS path, CASE WHEN lower(e) LIKE '.csv' OR lower(e) LIKE '.csv.gz' THEN 'csv' WHEN lower(e) SIMILAR TO '\\.(tsv|tab)(\\.(gz|bz2|zst))?' THEN 'tsv' ELSE 'smi' END AS format FROM nation CROSS JOIN (SELECT unnest(['.csv', '.CSV.gz', '.tsv.bz2', '.tab.zst', '.csv.bgzf', '.smi', '.tsv']) AS e)",
    "resume_semi_anti": "SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, 'redo' AS kind FROM nation WHERE n_nationkey IN (SELECT s_suppkey % 30 FROM supplier) UNION ALL SELECT DISTINCT s_suppkey % 30, 'missing' FROM supplier WHERE s_suppkey % 30 NOT IN (SELECT n_nationkey FROM nation)",
    "emb64_threshold": f"{_EMB} SELECT chunk_idx, query_idx, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(2, 5)}",
    "threshold_every50": f"{_pairs('k % 50 = 0')} SELECT chunk_idx, query_key AS query_id, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(1, 5)}",
    "threshold_bit_lists": f"{_pairs(_MANY)} SELECT chunk_idx, query_key AS query_id, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(3, 10)}",
    "emb64_every50": f"{_EMB} SELECT chunk_idx, query_key AS query_id, position, inter, denom, {_SCORE} FROM pairs WHERE {_hit(2, 5)}",
    "payload_every_row": f"WITH {_BITS} SELECT chunk_idx, position, c_name AS smiles, c_mktsegment AS compound_id FROM db",
}

QUERIES |= files.QUERIES
SQL |= files.sql(_BITS, _pairs, _SCORE, _hit)
