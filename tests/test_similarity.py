"""Scores, bounds and pruning against exact rational arithmetic."""

from contextlib import nullcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from popsieve.functions import similarity, text
from popsieve.operators import ingest, search
from popsieve.operators.database import Database
from popsieve.plans import standins
from popsieve.plans.bounds import allowed, may_match, shortlist
from popsieve.sources import chunks, delimited, lines, tables


def test_shortlists():
    assert shortlist([10, 50], 60, 128, 0.8, 1.0) == [1]
    assert shortlist([8], 8, 10, 0.0, 0.5) == []
    assert shortlist([0], 0, 10, 0.0, 1.0) == []


def test_pruning_is_sound():
    bits = 16
    for low, high in ((0.0, 1.0), (0.28, 0.9), (0.3, 0.3), (0.5, 1.0)):
        a, b = Fraction(str(low)), Fraction(str(high))
        for q in range(1, bits + 1):
            for n in range(bits + 1):
                real = any(a <= Fraction(i, n + q - i) <= b for i in range(max(0, n + q - bits), min(n, q) + 1))
                assert may_match(n, q, bits, low, high) or not real
    assert may_match(7, 25, 128, 0.28, 1.0)  # exactly on the bound


def test_integer_bounds():
    assert similarity.integer_bounds(7, 25, 0.28, 1.0) == (7, 7)
    assert similarity.integer_bounds(4, 4, 0.9, 0.95) is None
    assert allowed([4], 8, 0.5, 1.0) == [(0, n) for n in range(2, 9)]
    assert similarity.fingerprint_sizes(" 128,64, 128") == [64, 128]


# The short vectors below, their bounds and the scores expected of them are fixed values, which must be as they are.


def _db(spark, rows, bits=8):
    words, ones = search.packed(rows, bits)
    data = spark.createDataFrame([(0, k, w[0], f"s{k}", f"id{k}") for k, w in enumerate(words)], "chunk_id long, line_no long, w0 long, smiles string, compound_id string")
    return Database.build(data, bits)


def _bits(s):
    return [int(c) for c in s]


def test_scan_and_thresholds(spark):
    db = _db(spark, [_bits(x) for x in ("00000000", "10000000", "11110000", "11111111")])
    scan = search.get_sim_scores(db, _bits("11111111")).collect()
    assert sorted(r["score"] for r in scan) == [0, 13, 50, 100]
    assert sorted(r["score"] for r in search.get_sim_scores(db, _bits("00000000")).collect()) == [0, 0, 0, 100]
    assert search.get_sim_compounds(db, _bits("00000000"), 0.0, 1.0).count() == 0
    assert len(db) == 4
    db = _db(spark, [_bits(x) for x in ("11110000", "11101000", "11001100", "10001110")])
    queries = [_bits("11110000"), _bits("11000000")]
    hits = search.get_sim_compounds(db, queries, 0.5, 1.0).collect()
    assert sorted((r["query_idx"], r["position"], r["score"]) for r in hits) == [(0, 0, 100), (0, 1, 60), (1, 0, 50), (1, 1, 50), (1, 2, 50)]
    with pytest.raises(MemoryError):
        search.get_sim_compounds_multi_query(db, queries, 0.5, 1.0, max_hits_per_chunk=1)
    with pytest.raises(ValueError):
        search.get_sim_compounds_multi_query_with_scores(db, queries, 0.9, 0.5, "x")
    with pytest.raises(ValueError):
        search.packed([[1, 2]], 2)
    assert search.get_sim_compounds(db, queries, 0.9, 0.5).count() == 0


def test_lookup_and_storage(spark, tmp_path):
    db = _db(spark, [_bits("11110000"), _bits("11101000"), _bits("10000000")])
    chunk = db.catalog.where("onbits = 4").first()["chunk_idx"]
    found = db.get_smiles_and_ids_by_ref_indices({chunk: [1, 0, -1, 1]})
    assert [s for s, _ in found[chunk]] == ["s1", "s0", "s1", "s1"]
    with pytest.raises(Exception, match="out of range"):
        db.get_smiles_and_ids_by_ref_indices({chunk: [2]})
    db.save(str(tmp_path / "db"))
    again = Database.open(spark, str(tmp_path / "db"), 8)
    assert len(again) == 3 and again.first(1).fp.count() == 1
    plan = search.get_sim_compounds(again, _bits("11110000"), 0.9, 1.0)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "onbits" in plan.split("PartitionFilters")[1][:200]
    with pytest.raises(ValueError):
        Database.open(spark, str(tmp_path / "db"), 128)


def test_dedups_and_ids(spark):
    rows = spark.createDataFrame([(0, k + 1, f"C\t{i}") for k, i in enumerate(["ZINC1", "1", "2", "ZINC1"])], "chunk_id long, line_no long, line string")
    assert [r["line_no"] for r in ingest.download_filter(rows).orderBy("line_no").collect()] == [1, 3, 4]
    rows = spark.createDataFrame([(0, 1, "A"), (0, 2, "B"), (0, 3, "A"), (1, 4, "A")], "chunk_id long, line_no long, smiles string")
    assert sorted(r["line_no"] for r in ingest.dedup_keep_first(rows, "smiles").collect()) == [1, 2, 4]
    ids = spark.createDataFrame([("ZINC" + "a" * 12,), ("a" * 13,), ("zinc",), (None,)], "id string").select(text.short_id(F.col("id")).alias("s")).collect()
    assert [r["s"] for r in ids] == ["a" * 12, None, None, None]


def test_strict_fields():
    assert delimited.parse_fields('"a"b,c', ",") == ["ab", "c"]
    assert delimited.parse_fields('"a""b"', ",") == ['a"b']
    assert delimited.parse_fields('a"b', ",") is None and delimited.parse_fields('"a', ",") is None
    assert delimited.sniff_enamine("ID\tSMILES") == ("\t", 1, 0)
    assert [delimited.guess_format(x) for x in ("a.csv.gz", "a.tab", "a.csv.bgzf")] == ["csv", "tsv", "smi"]
    options = delimited.Options.parse(smiles="0", compound_id="none")
    assert not delimited.has_header(["smiles"], options) and delimited.resolve(["C"], False, options) == (0, None)


def test_generic_normalizer(spark):
    rows = spark.createDataFrame([(7, 1, "smiles"), (7, 2, ""), (7, 3, " CC ")], "chunk_id long, line_no long, line string")
    out = ingest.normalize_delimited(rows, ",").collect()
    assert [(r["smiles"], r["compound_id"]) for r in out] == [("CC", "mol_7_3")]


def test_tables():
    assert tables.parse_chunk_table(["chunk_id,abs_path,rel_path", "", "3,/a/b,c,d", ",x,y"]) == [(3, "/a/b", "c,d")]
    with pytest.raises(ValueError):
        tables.parse_chunk_table(["12x,/a,b"])
    assert tables.parse_download_line("/usr/bin/curl -s -o 'a b' https://x/y") == ("https://x/y", "a b")
    with pytest.raises(ValueError):
        tables.parse_download_line("wget x")
    assert tables.parse_unfinished(["1 # a", "# b", "2"]) == [1, 2]
    assert lines.output_path("a/b.gz") == "a/b.zst"


def test_compressed_lines(spark, tmp_path):
    import bz2
    import gzip

    body = b"one\r\n\ntwo\n"
    (tmp_path / "a.smi").write_bytes(body)
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"one\r\n") + gzip.compress(b"\ntwo\n"))
    (tmp_path / "c.bgzf").write_bytes(gzip.compress(body))
    (tmp_path / "d.bz2").write_bytes(bz2.compress(body))
    rows = lines.read_any(spark, [str(p) for p in sorted(tmp_path.iterdir())]).collect()
    for name in ("a.smi", "b.gz", "c.bgzf", "d.bz2"):
        assert sorted((r["line_no"], r["line"]) for r in rows if r["path"].endswith(name)) == [(1, "one"), (2, ""), (3, "two")]


def test_half_scores():
    assert similarity.half_score([1, 0], [3, 0]).tolist() == [np.float16(1 / 3), 1.0]


@pytest.mark.parametrize(("most", "salted"), [(16 << 20, 100_000), (0, 100_000), (0, 3)])
def test_queries_as_rows(spark, monkeypatch, most, salted):
    """Every 50th row as a query, broadcast, joined or salted, gives the hits of the search by vectors."""
    monkeypatch.setattr(search, "SALTED_QUERIES", salted)
    rows = standins.basket(spark, "/root/testdata/sf0.001").cache()
    db = standins.Database.build(rows, 128)
    wanted = sorted(r["line_no"] for r in rows.where("line_no % 50 = 0").select("line_no").collect())
    plain = search.get_sim_compounds_multi_query(db, standins.vectors(rows, 128, wanted), 0.2)
    monkeypatch.setattr(search, "BROADCAST_BYTES", most)
    found = search.get_sim_compounds_of_rows(db, rows.where("line_no % 50 = 0").withColumnRenamed("line_no", "query_id"), 0.2)
    assert ("BroadcastNestedLoopJoin" in found._jdf.queryExecution().toString()) == (most > 0)
    names = ["chunk_idx", "position", "inter", "denom", "score"]
    got = sorted(tuple(r) for r in found.select("query_id", *names).collect())
    assert got and got == sorted((wanted[r[0]], *r[1:]) for r in plain.select("query_idx", *names).collect())


def test_scores_with_supplied_counts(spark):
    """The on-bit counts that come with the rows are those that count."""
    words, _ = search.packed([_bits(x) for x in ("00000000", "10000000", "11110000", "11111111")], 8)
    data = spark.createDataFrame([(0, k, 8, w[0]) for k, w in enumerate(words)], "chunk_id long, line_no long, onbits int, w0 long")
    db = Database.build(data, 8)
    assert sorted(r["score"] for r in search.get_sim_scores(db, _bits("11111111")).collect()) == [0, 7, 33, 100]
    assert search.raw_scores(db, _bits("11111111")).tolist() == [0, 7, 33, 100]


@pytest.mark.parametrize("size", [8, 16, 32, 64])
def test_scores_of_wide_rows(spark, size):
    """Rows of bytes in order, with counts supplied, against plain arithmetic."""
    rows = np.arange(9 * size, dtype=np.uint8).reshape(9, size)
    query = np.arange(size, dtype=np.uint8)
    bits, q = np.unpackbits(rows, axis=1), np.unpackbits(query)
    for counts in ([8 * size] * 9, [int(q.sum())] * 9):
        words, _ = search.packed(bits, 8 * size)
        data = spark.createDataFrame([(0, k, counts[k], *w) for k, w in enumerate(words)], "chunk_id long, line_no long, onbits int, " + ", ".join(f"{n} long" for n in similarity.word_names(8 * size)))
        inter = (bits & q).sum(1)
        wanted = [int(100 * Fraction(int(i), counts[0] + int(q.sum()) - int(i)) + Fraction(1, 2)) for i in inter]
        found = search.get_sim_scores(Database.build(data, 8 * size), q).orderBy("position").collect()
        assert [r["score"] for r in found] == wanted


def test_searches_in_several_broadcasts(spark, monkeypatch):
    """Queries that don't fit in one broadcast, or that are salted, give the same hits."""
    rows = standins.basket(spark, "/root/testdata/sf0.001")
    db, vectors = Database.build(rows, 128), standins.vectors(rows, 128, list(range(30)))
    queries = rows.where("line_no < 30").withColumnRenamed("line_no", "query_id")
    names = ["chunk_idx", "position", "inter", "denom", "score"]

    def hits():
        many = search.get_sim_compounds_multi_query(db, vectors, 0.2).select("query_idx", *names).collect()
        return sorted(map(tuple, many)), sorted(map(tuple, search.get_sim_compounds_of_rows(db, queries, 0.2).select("query_id", *names).collect()))

    plain = hits()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 500)
    monkeypatch.setattr(search, "SALTED_QUERIES", 3)
    assert len(search.query_relation(db, vectors, 0.2, 1.0)) > 1 and hits() == plain and plain[0]


def test_resume(spark, tmp_path):
    """Building a chunk anew replaces all of its rows, drops folders that are left empty and numbers the manifest anew."""
    schema, path = "chunk_id long, line_no long, w0 long, smiles string, compound_id string", str(tmp_path / "db")

    def data(chunk, *vectors):
        return [(chunk, k, w[0], f"s{chunk}{k}", "x") for k, w in enumerate(search.packed([_bits(v) for v in vectors], 8)[0])]

    Database.build(spark.createDataFrame(data(0, "11110000", "10000000") + data(1, "11110000", "11111111"), schema), 8).save(path)
    Database.build(spark.createDataFrame(data(0, "11100000"), schema), 8).save(path, only_chunks=[0])
    db = Database.open(spark, path, 8)
    assert len(db) == db.fp.count() == db.payload.count() == 3
    assert sorted((r["chunk_id"], r["onbits"], r["chunk_idx"]) for r in db.fp.collect()) == [(0, 3, 0), (1, 4, 1), (1, 8, 2)]
    assert not (tmp_path / "db" / "fp" / "onbits=1" / "chunk_group=0").exists()
    hits = search.get_sim_compounds(db, _bits("11111111"), 0.9, 1.0, return_smiles=True)
    assert [r["smiles"] for r in hits.collect()] == ["s11"]
    for table in ("fp", "payload"):  # both scans are pruned by literals
        scan = next(x for x in hits._jdf.queryExecution().toString().split("FileScan parquet")[1:] if f"/{table}" in x.split("PushedFilters")[0])
        assert "onbits" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_bit_lists_salted(spark, monkeypatch):
    rows = standins.basket(spark, "/root/testdata/sf0.001")
    db, queries = Database.build(rows, 128), rows.where("line_no < 30").withColumnRenamed("line_no", "query_id")
    plain = sorted(map(tuple, search.get_sim_compounds_of_rows(db, queries, 0.25).collect()))
    assert plain and sorted(map(tuple, search.get_sim_compounds_by_bits(db, queries, 0.25).collect())) == plain
    monkeypatch.setattr(search, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, search.get_sim_compounds_by_bits(db, queries, 0.25).collect())) == plain
    with pytest.raises(ValueError):
        search.get_sim_compounds_by_bits(db, queries, 0.0)


def test_missing_files_of_a_chunk_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text(f"chunk_id,abs_path,rel_path\n1,{tmp_path}/t.csv,t\n2,{tmp_path}/none,n\n")
    assert tables.read_chunk_table(spark, f"{tmp_path}/t.csv").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_chunk_table(spark, f"{tmp_path}/t.csv", must_exist=True)


def test_names_and_columns():
    assert [lines.output_path(x) for x in ("a/b.zst", "/a/b.ZST", "x.smi", "a.BZ2")] == ["a/b.zst", "b.ZST", "x.smi.zst", "a.zst"]
    assert lines.output_path("", "/in/c.gz") == "c.zst"
    with pytest.raises(ValueError):
        lines.output_path("b.zst", "/out/a/../b.zst", "/out")


def test_headerless_columns_out_of_range(spark):
    rows = spark.createDataFrame([(1, 1, "C,x"), (1, 2, "N,y")], "chunk_id long, line_no long, line string")
    for options in ({"smiles": "5"}, {"smiles": "0", "compound_id": "2"}):
        with pytest.raises(ValueError):
            ingest.normalize_delimited(rows, ",", delimited.Options.parse(**options))


def test_stream_of_queries(spark, tmp_path):
    """Batches of queries find what a search of all of them finds."""
    from popsieve.streaming.search import start

    rows = standins.basket(spark, "/root/testdata/sf0.001")
    db = Database.build(rows, 128)
    queries = rows.where("line_no < 20").select(F.col("line_no").cast("int").alias("query_idx"), F.col("w0").alias("q0"), F.col("w1").alias("q1"))
    for k in range(2):
        queries.where(F.col("query_idx") % 2 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(queries.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start(db, stream, 0.3, 1.0, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    keys = sorted(r["query_idx"] for r in queries.collect())
    plain = search.get_sim_compounds_multi_query(db, standins.vectors(rows, 128, keys), 0.3)
    found = sorted((r["chunk_idx"], r["query_idx"], r["position"], r["score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found and found == sorted((r["chunk_idx"], keys[r["query_idx"]], r["position"], r["score"]) for r in plain.collect())


def test_sql_functions(spark):
    similarity.register(spark)
    row = spark.sql("SELECT fp_intersection(array(3L, 1L), array(1L, 1L)) i, fp_tanimoto(array(3L, 1L), array(1L, 1L)) t, fp_centi_score(array(3L, 1L), array(1L, 1L)) s, fp_centi_score(array(0L), array(0L)) e").first()
    assert (row["i"], row["t"], row["s"], row["e"]) == (2, 2 / 3, 67, 100)


def test_log_without_repeats(capsys):
    from popsieve.log import get_logger

    logger = get_logger("popsieve-test")
    for word in ("one", "one", "two", "one"):
        logger.warning(word)
    assert [line.rsplit(" ", 1)[-1] for line in capsys.readouterr().err.splitlines()] == ["one", "two", "one"]


def test_part_order(spark):
    """Parts 0 to 10 stand in the order of their names."""
    words, _ = search.packed([_bits("10000000")] * 11, 8)
    data = spark.createDataFrame([(0, k, w[0]) for k, w in enumerate(words)], "chunk_id long, line_no long, w0 long")
    db = Database.build(data, 8, part_rows=1)
    assert [r["part"] for r in db.catalog.orderBy("chunk_idx").collect()] == [0, 1, 10, 2, 3, 4, 5, 6, 7, 8, 9]
    ids = spark.createDataFrame([(2,)], "gid long")
    assert tuple(db.global_to_chunk_position(ids).first()) == (2, 2, 0)


def test_more_frames_than_packed_references(spark, tmp_path):
    """References of many frames are whole numbers as they are read; packing ones of over 32 bits is an error, not a wrong number."""
    rows = spark.range(1, 8196).select(F.lit(5).cast("long").alias("chunk_id"), F.col("id").alias("line_no"), F.concat(F.lit("x"), "id").alias("line"))
    files = chunks.write_chunks(rows, f"{tmp_path}/zst", frame_bytes=1, level=1)
    found = sorted(map(tuple, chunks.read_frames_lines(spark, f"{tmp_path}/zst/*.zst").select("line_no", "ref", "line").collect()))
    assert found == [(k, (k - 1) << 19, f"x{k}") for k in range(1, 8196)]
    for ref, good in ((8191 << 19, True), (8192 << 19, False)):
        placed = spark.createDataFrame([(5, 1, 0, 0, ref, 1)], "chunk_id long, onbits int, part long, position long, ref long, w0 long")
        with nullcontext() if good else pytest.raises(Exception, match="past the frames"):
            chunks.export(placed, 64, files, f"{tmp_path}/out")


def test_bit_lists_give_a_pair_once_without_grouping(spark):
    """Dense vectors, of which most pairs share bits: no pair is shuffled to be counted."""
    rng = np.random.default_rng(2)
    words, _ = search.packed(rng.random((60, 128)) < 0.4, 128)
    rows = spark.createDataFrame([(0, k, *w) for k, w in enumerate([*words, [0, 0], [-1, -1], [1, 0], [0, 1], [-(1 << 63), 0]])], "chunk_id long, line_no long, w0 long, w1 long").coalesce(1)
    db, queries = Database.build(rows, 128), rows.withColumnRenamed("line_no", "query_id")
    for low, high in ((0.01, 1.0), (0.2, 0.4), (0.3, 0.3), (1.0, 1.0)):
        found = search.get_sim_compounds_by_bits(db, queries, low, high)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.get_sim_compounds_of_rows(db, queries, low, high).collect()))
        assert "query_id" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
