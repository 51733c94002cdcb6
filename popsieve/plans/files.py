"""Registered queries that write files and read them again: codecs, builds from lines, stored databases, exports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import ingest, search
from ..operators.chemistry import with_canonical
from ..operators.database import Database
from ..session import shared_path
from ..sources import chunks, delimited, lines, tables
from . import standins


class Letters:
    """A backend that SQL can say: a SMILES is canonical as it is, unless it has a `!`; its bits are its characters."""

    exact = False

    def canonical(self, smiles: str) -> str | None:
        return None if "!" in smiles else smiles

    def fingerprint(self, smiles: str, bits: int) -> np.ndarray | None:
        if "!" in smiles:
            return None
        out = np.zeros(bits, np.uint8)
        out[[ord(c) % bits for c in smiles]] = 1
        return out


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id (the nation), line_no (from 1 by key), c_custkey, c_name, c_mktsegment."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("chunk_id"), F.col("c_custkey").alias("line_no"), "c_custkey", "c_name", "c_mktsegment")
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("chunk_id").orderBy("line_no")).cast("long"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized lines: name TAB segment; some can't be parsed."""
    bad = F.when(F.col("c_custkey") % 11 == 0, "!").otherwise("")
    return _people(spark, sf_dir).select("chunk_id", "line_no", F.concat("c_name", bad, F.lit("\t"), "c_mktsegment").alias("line"))


_LINES = """people AS (SELECT CAST(c_nationkey AS BIGINT) AS chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no, c_custkey, c_name, c_mktsegment FROM customer),
lines AS (SELECT chunk_id, line_no, c_custkey, c_name || CASE WHEN c_custkey % 11 = 0 THEN '!' ELSE '' END AS smiles, c_mktsegment AS compound_id FROM people)"""


def _chunk_of(path: Column) -> Column:
    return F.regexp_extract(path, r"chunk_([0-9]+)", 1).cast("long")


def _read_back(spark, sf_dir, codec: str, suffix: str) -> DataFrame:
    out = shared_path(spark, "lines")
    name = F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"), F.lit(suffix))
    chunks.write_chunks(_lines(spark, sf_dir), out, name, codec)
    back = lines.read_any(spark, [f"{out}/*{suffix}"])
    return back.select(_chunk_of(F.col("path")).alias("chunk_id"), "line_no", "line")


def lines_gzip(spark, sf_dir):
    return _read_back(spark, sf_dir, "gzip", ".gz")


def lines_zstd(spark, sf_dir):
    return _read_back(spark, sf_dir, "zstd", ".zst")


def lines_bgzf(spark, sf_dir):
    return _read_back(spark, sf_dir, "gzip", ".bgzf")


def lines_any(spark, sf_dir):
    """Plain, gzip, bzip2 and zstd files in one reader."""
    rows = _lines(spark, sf_dir).withColumn("line", F.concat("line", F.lit("\r")))
    paths = []
    for codec in ("none", "gzip", "bzip2"):
        paths.append(shared_path(spark, f"lines-{codec}"))
        lines.write_lines(rows, F.col("line"), paths[-1], codec)
    paths.append(shared_path(spark, "lines-zstd"))
    chunks.write_chunks(rows, paths[-1])
    back = lines.read_any(spark, paths, numbered=False)
    return back.select(F.regexp_extract("path", "lines-([a-z0-9]+)-", 1).alias("codec"), "line")


def frames_refs(spark, sf_dir):
    """A frame a line, so that references can be said in SQL."""
    out = shared_path(spark, "frames")
    chunks.write_chunks(_lines(spark, sf_dir), out, frame_bytes=1, level=1)
    return chunks.read_frames_lines(spark, f"{out}/*.zst").select(_chunk_of(F.col("path")).alias("chunk_id"), "line_no", "ref", "line")


def _built(spark, sf_dir, bits: int) -> tuple[Database, DataFrame, DataFrame]:
    """(database, its chunk files, their lines) by way of framed files."""
    out = shared_path(spark, "normalized")
    files = chunks.write_chunks(_lines(spark, sf_dir), out, frame_bytes=4096, level=3)
    back = chunks.read_frames_lines(spark, f"{out}/*.zst").select(_chunk_of(F.col("path")).alias("chunk_id"), "line_no", "ref", "line")
    return Database.from_lines(back, [bits], Letters)[bits], files, back


def _rows(db: Database) -> DataFrame:
    found = db.lookup(db.fp.select("chunk_idx", "position", F.col("onbits").cast("long").alias("onbits")))
    return found.select("chunk_idx", "position", "onbits", "smiles", "compound_id")


def build_from_lines(spark, sf_dir):
    """Lines, fingerprints, parts, storage and the stored database's payload."""
    db, _, _ = _built(spark, sf_dir, 64)
    out = shared_path(spark, "db")
    db.save(out)
    return _rows(Database.open(spark, out, 64))


def export_import(spark, sf_dir):
    """The same by .npy, .refs, .frames, framed chunk files and their manifest."""
    db, files, back = _built(spark, sf_dir, 64)
    named = db.catalog.select("chunk_idx", "chunk_id")
    rows = db.fp.join(db.payload.select("chunk_idx", "position", "smiles", "compound_id"), ["chunk_idx", "position"]).join(F.broadcast(named), ["chunk_idx", "chunk_id"])
    refs = back.select("chunk_id", "ref", text.tab_field(F.col("line"), 0).alias("smiles"))  # names are unique
    out = shared_path(spark, "export")
    chunks.export(rows.join(refs, ["chunk_id", "smiles"]), 64, files, out)
    return _rows(chunks.import_database(spark, f"{out}/manifest", 64))


def _stored(spark, sf_dir) -> Database:
    out = shared_path(spark, "db")
    standins.basket_db(spark, sf_dir).save(out)
    return Database.open(spark, out, 128)


def stored_threshold(spark, sf_dir):
    """Every 50th row of a stored database as a query, with payload."""
    db = _stored(spark, sf_dir)
    queries = standins.basket(spark, sf_dir).where("line_no % 50 = 0").withColumnRenamed("line_no", "query_id")
    hits = search.get_sim_compounds_of_rows(db, queries, 0.3)
    return db.lookup(hits).select("chunk_idx", "query_id", "position", "score", "smiles", "compound_id")


def hits_tsv_roundtrip(spark, sf_dir):
    """The lines of the hit files, without their headers."""
    out = shared_path(spark, "hits")
    search.write_hits(search.hit_rows(stored_threshold(spark, sf_dir).withColumnRenamed("query_id", "query_idx")), out)
    header = "chunk_idx\tquery_idx\tposition\tscore\tsmiles\tcompound_id"
    return spark.read.text(out).where(F.col("value") != header).select(F.col("value").alias("line"))


def scores_raw(spark, sf_dir):
    """A byte a row in global order, written and read again."""
    rows, out = standins.basket(spark, sf_dir), shared_path(spark, "scores")
    chunks.write_raw_scores(search.global_scores(Database.build(rows, 128), standins.vectors(rows, 128, [7])), out)
    return chunks.read_raw_scores(spark, out)


def resume_rebuild(spark, sf_dir):
    """A stored database of which chunks 0 to 4 are built anew from their even customers."""
    rows, out = standins.basket(spark, sf_dir), shared_path(spark, "db")
    Database.build(rows, 128).save(out)
    Database.build(rows.where("chunk_id <= 4 and line_no % 2 = 0"), 128).save(out, only_chunks=[0, 1, 2, 3, 4])
    db = Database.open(spark, out, 128)
    return db.lookup(db.fp.select("chunk_idx", "chunk_id", "position", F.col("onbits").cast("long").alias("onbits"))).select("chunk_idx", "chunk_id", "onbits", "position", "smiles", "compound_id")


def scan_tanimoto(spark, sf_dir):
    """Single-precision scores of a search without lower bound, as doubles."""
    rows = standins.basket(spark, sf_dir)
    hits = search.get_sim_compounds(Database.build(rows, 128), standins.vectors(rows, 128, [7]), 0.0, 1.0)
    return hits.select("chunk_idx", "position", F.col("tanimoto").cast("double").alias("tanimoto"))


def supplied_onbits(spark, sf_dir):
    """Scores by on-bit counts that come with the rows, not by counted ones."""
    rows = standins.basket(spark, sf_dir).withColumn("onbits", (similarity.ones([F.col("w0"), F.col("w1")]) + F.col("line_no") % 3).cast("int"))
    return search.get_sim_scores(Database.build(rows, 128), standins.vectors(rows, 128, [7]))


def _by_key(*cases: str) -> Column:
    """cases[c_custkey % their number], where {} is the name."""
    out = F.lit(None).cast("string")
    for k, case in enumerate(cases):
        before, after = case.split("{}") if "{}" in case else (case, None)
        value = F.lit(case) if after is None else F.concat(F.lit(before), F.col("c_name"), F.lit(after))
        out = F.when(F.col("c_custkey") % len(cases) == k, value).otherwise(out)
    return out


def strict_fields(spark, sf_dir):
    rows = _people(spark, sf_dir).select("c_custkey", _by_key("{},b", '"{}, ""x""",b', '"{}"b,c', '{}"b,c', '"{},c').alias("line"))
    found = delimited.with_fields(rows, ",")
    return found.select("c_custkey", F.array_join("fields", "|").alias("fields"))


def _headed(spark, sf_dir, header: str, *cases: str) -> DataFrame:
    """One file's lines: a header, a blank line, then a line a customer."""
    body = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(7).cast("long").alias("chunk_id"), (F.col("c_custkey") + 3).alias("line_no"), "c_custkey", "c_name")
    head = spark.createDataFrame([(7, 1, header), (7, 2, " \t ")], "chunk_id long, line_no long, line string")
    return body.select("chunk_id", "line_no", _by_key(*cases).alias("line")).union(head)


def normalize_csv(spark, sf_dir):
    """A header in any case, ids to be trimmed or made up, empty and unreadable SMILES, short rows."""
    rows = _headed(spark, sf_dir, "﻿ID, Smiles ,x", "\t{}\x0b,CC ,1", ",{},1", '"a\tb", {}\t,', "id,!{},1", "id, ,{}", "{}")
    return ingest.normalize_delimited(rows, ",", make=Letters)


def normalize_smiles(spark, sf_dir):
    rows = _headed(spark, sf_dir, "", "{}", "\t{} |ext| a\tname ", "{} name", "!{} name", "   ").where("line_no > 2")
    return ingest.normalize_smi(rows, make=Letters)


def enamine_rows(spark, sf_dir):
    return ingest.enamine(_headed(spark, sf_dir, "Smiles\tx\tID", "{}\t\t a ", "!{}\tb\tc", "{}\tb", "\t{}\tc", '"{}"\tb\t').where("line_no != 2"), Letters)


def remove_stereo_lines(spark, sf_dir):
    """Ids that repeat or are too long, SMILES that repeat in a chunk or are too long."""
    smiles = F.when(F.col("c_custkey") % 13 == 0, F.repeat(F.lit("C"), 163)).when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("!"), "c_name")).otherwise(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")))
    ids = F.when(F.col("c_custkey") % 7 == 0, F.lit("Z" * 13)).otherwise(F.concat(F.when(F.col("c_custkey") % 2 == 0, "zinc").otherwise(""), F.floor(F.col("c_custkey") / 3).cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 4).alias("chunk_id"), F.col("c_custkey").alias("line_no"), F.concat_ws("\t", smiles, ids).alias("line"))
    return ingest.zinc_lines(ingest.remove_stereo(rows, Letters))


def canonical_null(spark, sf_dir):
    rows = _people(spark, sf_dir).select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "!").otherwise("")).alias("smiles"))
    return with_canonical(rows, Letters).select("c_custkey", "canonical")


def chunk_tables(spark, sf_dir):
    """Rows of a chunk table with a header, blanks and commas in its last column."""
    out = shared_path(spark, "table")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" , /data/"), "n_name", F.lit(".gz,"), "n_name", F.lit(",x.gz")).alias("line"))
    head = spark.createDataFrame([("chunk_id,abs_path,rel_path",)], "line string")
    head.union(spark.createDataFrame([("",), (",/no/id,x",)], "line string")).union(rows).coalesce(1).write.text(out)
    return tables.read_chunk_table(spark, out)


def curl_scripts(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").toPandas()["n_name"]  # 25 rows
    script = ["# a comment", ""] + [f"/usr/bin/curl --fail -o 'out dir/{n}.smi.gz' https://x.example/{n}" for n in names]
    return spark.createDataFrame(tables.parse_download_script(script), "chunk_id long, url string, output_path string, base_name string")


def download_status(spark, sf_dir):
    jobs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("chunk_id"), F.concat(F.lit("https://x/"), F.col("n_nationkey").cast("string")).alias("url"), F.col("n_name").alias("output_path"))

    def fetch(url: str, path: str) -> str:
        number = int(url.rsplit("/", 1)[-1])
        if number % 5 == 0:
            raise FileNotFoundError(url)
        if number % 5 == 1:
            raise OSError(url)
        return path

    return tables.download(jobs, fetch)


def download_totals(spark, sf_dir):
    """Lines of the download filter, and those it keeps."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).alias("chunk_id"), F.col("o_orderkey").alias("line_no"), F.concat_ws("\t", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("line"))
    return ingest.totals(rows, ingest.download_filter(rows))


def output_paths(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").toPandas()["n_name"]  # 25 rows
    ends = [".gz", ".BGZF", ".bz2", ".zst", ".smi", ""]
    rows = [(f"{top}{n}{e}", lines.output_path(f"{top}{n}{e}")) for n in names for e in ends for top in ("", "a/", "/a/")]
    return spark.createDataFrame(rows, "path string, output string")


def existing_outputs(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    table = nations.select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_name").alias("abs_path"), F.col("n_name").alias("rel_path"))
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 20").select(F.col("s_nationkey").cast("long").alias("chunk_id"))
    out = shared_path(spark, "existing")
    tables.write_chunk_table(tables.existing(table, found), out)
    return tables.read_chunk_table(spark, out).select("chunk_id", "abs_path")


def sanitize_ends(spark, sf_dir):
    """Ids with white space of all kinds at their ends and inside."""
    return _people(spark, sf_dir).select("c_custkey", text.sanitized_id(_by_key("\t{}\t", " \x0b{}\r\n", "a\t{}\x0c ", "{}")).alias("id"))


def manifest_parts(spark, sf_dir):
    """Parts of three rows, in the order of their files' names (part 10 before part 2)."""
    catalog = Database.build(standins.basket(spark, sf_dir), 128, part_rows=3).catalog
    return catalog.select("chunk_idx", "chunk_id", F.col("onbits").cast("long").alias("onbits"), "part", "path", "size", "start", "end")


def first_parts(spark, sf_dir):
    """The rows of the manifest's first 20 parts of a stored database, with payload."""
    out = shared_path(spark, "db")
    standins.basket_db(spark, sf_dir).save(out)
    return _rows(Database.open(spark, out, 128, max_files=20))


def on_bit_queries(spark, sf_dir):
    """Queries given by the numbers of their set bits: one a multiple of 8."""
    vectors = search.from_on_bits([range(k, 128, 8) for k in range(8)], 128)
    db = standins.basket_db(spark, sf_dir)
    hits = search.get_sim_compounds(db, vectors, 0.1)
    return hits.select(F.col("query_idx").cast("long").alias("query_idx"), "chunk_idx", "position", "inter", "denom", "score")


QUERIES = {f.__name__: f for f in (
    manifest_parts, first_parts, on_bit_queries,
    lines_gzip, lines_zstd, lines_bgzf, lines_any, frames_refs, build_from_lines, export_import, stored_threshold, hits_tsv_roundtrip, scores_raw, resume_rebuild,
    scan_tanimoto, supplied_onbits, strict_fields, normalize_csv, normalize_smiles, enamine_rows, remove_stereo_lines, canonical_null, chunk_tables, curl_scripts,
    download_status, download_totals, output_paths, existing_outputs, sanitize_ends,
)}


def _case(*cases: str) -> str:
    return "CASE c_custkey % " + str(len(cases)) + " " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(cases)) + " END"


_NUMBERED = f"WITH {_LINES} SELECT chunk_id, line_no, smiles || chr(9) || compound_id AS line FROM lines"
_FROM_LINES = f"""WITH {_LINES},
bits AS (SELECT DISTINCT c_custkey, ord(c) % 64 AS bit FROM (SELECT c_custkey, unnest(string_split(smiles, '')) AS c FROM lines WHERE c_custkey % 11 <> 0)),
ones AS (SELECT c_custkey, count(*) AS onbits FROM bits GROUP BY c_custkey),
placed AS (SELECT chunk_id, onbits, row_number() OVER (PARTITION BY chunk_id, onbits ORDER BY line_no) - 1 AS position, smiles, compound_id FROM lines JOIN ones USING (c_custkey)),
manifest AS (SELECT chunk_id, onbits, row_number() OVER (ORDER BY chunk_id, onbits) - 1 AS chunk_idx FROM placed GROUP BY chunk_id, onbits)
SELECT chunk_idx, position, onbits, smiles, compound_id FROM placed JOIN manifest USING (chunk_id, onbits)"""


def sql(bits: str, pairs, score: str, hit) -> dict[str, str]:
    """SQL of the queries above; the arguments are the catalog's parts for baskets."""
    every = f"{pairs('k % 50 = 0')} SELECT chunk_idx, query_key AS query_id, position, {score}, c_name AS smiles, c_mktsegment AS compound_id FROM pairs WHERE {hit(3, 10)}"
    return {
        "manifest_parts": f"""WITH {bits}, places AS (SELECT chunk_id, onbits, position // 3 AS part, count(*) AS size FROM fp GROUP BY ALL),
named AS (SELECT *, 'fp_128/chunk_' || chunk_id || '_onbits_' || onbits || CASE WHEN max(part) OVER (PARTITION BY chunk_id, onbits) > 0 THEN '_part_' || part ELSE '' END || '.npy' AS path FROM places)
SELECT row_number() OVER w - 1 AS chunk_idx, chunk_id, onbits, part, path, size, CAST(sum(size) OVER w - size AS BIGINT) AS start, CAST(sum(size) OVER w AS BIGINT) AS "end" FROM named WINDOW w AS (ORDER BY chunk_id, onbits, path)""",
        "first_parts": f"WITH {bits} SELECT chunk_idx, position, onbits, c_name AS smiles, c_mktsegment AS compound_id FROM db WHERE chunk_idx < 20",
        "on_bit_queries": f"""WITH {bits}, q AS (SELECT query_idx, count(bit) AS inter, k FROM (SELECT unnest(range(8)) AS query_idx) CROSS JOIN ones LEFT JOIN bits USING (k) WHERE bit % 8 = query_idx GROUP BY query_idx, k),
pairs AS (SELECT query_idx, chunk_idx, position, inter, 16 AS ones_q, onbits, 16 + onbits - inter AS denom FROM q JOIN db USING (k))
SELECT query_idx, chunk_idx, position, inter, denom, {score} FROM pairs WHERE {hit(1, 10)}""",
        "lines_gzip": _NUMBERED,
        "lines_zstd": _NUMBERED,
        "lines_bgzf": _NUMBERED,
        "lines_any": f"WITH {_LINES} SELECT codec, smiles || chr(9) || compound_id AS line FROM lines CROSS JOIN (SELECT unnest(['none', 'gzip', 'bzip2', 'zstd']) AS codec)",
        "frames_refs": f"WITH {_LINES} SELECT chunk_id, line_no, (line_no - 1) * 524288 AS ref, smiles || chr(9) || compound_id AS line FROM lines",
        "build_from_lines": _FROM_LINES,
        "export_import": _FROM_LINES,
        "stored_threshold": every,
        "hits_tsv_roundtrip": f"WITH h AS ({every}) SELECT concat_ws(chr(9), chunk_idx, query_id, position, score, smiles, compound_id) AS line FROM h",
        "scores_raw": f"{pairs('k = 7')} SELECT CAST(start + position AS BIGINT) AS gid, {score} FROM pairs",
        "resume_rebuild": f"""WITH {bits.replace("JOIN customer ON c_custkey = k)", "JOIN customer ON c_custkey = k WHERE c_nationkey > 4 OR k % 2 = 0)")},
own AS (SELECT db.*, c_nationkey FROM db JOIN customer ON c_custkey = k) SELECT chunk_idx, CAST(c_nationkey AS BIGINT) AS chunk_id, onbits, position, c_name AS smiles, c_mktsegment AS compound_id FROM own""",
        "scan_tanimoto": f"{pairs('k = 7')} SELECT chunk_idx, position, CAST(CAST(CAST(inter AS DOUBLE) / denom AS FLOAT) AS DOUBLE) AS tanimoto FROM pairs",
        "supplied_onbits": f"""{pairs('k = 7')}, counted AS (SELECT k, inter, ones_q, onbits + k % 3 AS onbits FROM pairs),
fp2 AS (SELECT *, CAST(c_nationkey AS BIGINT) AS chunk_id, row_number() OVER (PARTITION BY c_nationkey, onbits ORDER BY k) - 1 AS position, ones_q + onbits - inter AS denom FROM counted JOIN customer ON c_custkey = k),
manifest2 AS (SELECT chunk_id, onbits, row_number() OVER (ORDER BY chunk_id, onbits) - 1 AS chunk_idx FROM fp2 GROUP BY chunk_id, onbits)
SELECT chunk_idx, position, {score} FROM fp2 JOIN manifest2 USING (chunk_id, onbits)""",
        "strict_fields": f"""SELECT c_custkey, {_case("c_name || '|b'", "c_name || ', \"x\"|b'", "c_name || 'b|c'", 'NULL', 'NULL')} AS fields FROM customer""",
        "normalize_csv": f"""WITH t AS (SELECT c_custkey, c_custkey % 6 AS m, c_custkey + 3 AS line_no, c_name FROM customer)
SELECT CAST(7 AS BIGINT) AS chunk_id, line_no, CASE m WHEN 0 THEN 'CC' ELSE c_name END AS smiles, CASE m WHEN 0 THEN c_name WHEN 1 THEN 'mol_7_' || line_no ELSE 'a b' END AS compound_id FROM t WHERE m IN (0, 1, 2)""",
        "normalize_smiles": "WITH t AS (SELECT c_custkey % 5 AS m, c_custkey + 3 AS line_no, c_name FROM customer) SELECT CAST(7 AS BIGINT) AS chunk_id, line_no, c_name AS smiles, CASE m WHEN 0 THEN 'mol_7_' || line_no WHEN 1 THEN 'a name' ELSE 'name' END AS compound_id FROM t WHERE m IN (0, 1, 2)",
        "enamine_rows": "WITH t AS (SELECT c_custkey % 5 AS m, c_custkey + 3 AS line_no, c_name FROM customer) SELECT CAST(7 AS BIGINT) AS chunk_id, line_no, c_name AS smiles, CASE m WHEN 0 THEN ' a ' ELSE '' END AS compound_id FROM t WHERE m IN (0, 4)",
        "remove_stereo_lines": """WITH t AS (SELECT c_custkey AS line_no, c_custkey % 4 AS chunk_id, CASE WHEN c_custkey % 13 = 0 THEN repeat('C', 163) WHEN c_custkey % 5 = 0 THEN '!' || c_name ELSE c_mktsegment || (c_custkey % 40) END AS smiles,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey // 3 AS VARCHAR) END AS id, c_custkey % 2 = 0 AS zinc FROM customer),
u AS (SELECT * FROM t WHERE length(smiles) <= 162),
v AS (SELECT *, lag(id) OVER (PARTITION BY chunk_id ORDER BY line_no) AS before FROM u WHERE id IS NOT NULL),
w AS (SELECT chunk_id, line_no, smiles, id, zinc FROM v WHERE id IS DISTINCT FROM before UNION ALL SELECT chunk_id, line_no, smiles, id, zinc FROM u WHERE id IS NULL)
SELECT chunk_id, line_no, smiles || CASE WHEN id IS NULL THEN '' ELSE chr(9) || CASE WHEN zinc THEN 'ZINC' ELSE '' END || id END AS line FROM w WHERE smiles NOT LIKE '%!%'
QUALIFY row_number() OVER (PARTITION BY chunk_id, smiles ORDER BY line_no) = 1""",
        "canonical_null": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS canonical FROM customer",
        "chunk_tables": "SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, '/data/' || n_name || '.gz' AS abs_path, n_name || ',x.gz' AS rel_path FROM nation",
        "curl_scripts": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS chunk_id, 'https://x.example/' || n_name AS url, 'out dir/' || n_name || '.smi.gz' AS output_path, n_name || '.smi' AS base_name FROM nation",
        "download_status": "SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, CASE n_nationkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'failed' ELSE 'ok' END AS status FROM nation",
        "download_totals": "WITH t AS (SELECT o_orderpriority[1:1] IS DISTINCT FROM lag(o_orderpriority[1:1]) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS good FROM orders) SELECT count(*) AS \"read\", count(*) FILTER (good) AS kept FROM t",
        "output_paths": "SELECT top || n_name || e AS path, CASE WHEN top = '/a/' THEN '' ELSE top END || n_name || CASE WHEN lower(e) IN ('.gz', '.bgzf', '.bz2', '.zst') THEN '.zst' ELSE e || '.zst' END AS output FROM nation CROSS JOIN (SELECT unnest(['.gz', '.BGZF', '.bz2', '.zst', '.smi', '']) AS e) CROSS JOIN (SELECT unnest(['', 'a/', '/a/']) AS top)",
        "existing_outputs": "SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, n_name AS abs_path FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 20)",
        "sanitize_ends": f"SELECT c_custkey, {_case('c_name', 'c_name', 'concat(chr(97), chr(32), c_name)', 'c_name')} AS id FROM customer",
    }
