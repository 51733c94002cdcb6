"""The corpus pipeline's stages and run() against plain Python, on a small fixture with nulls, a repeated id and copies."""

import re

import corpus_pipeline
import numpy as np


def letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = {k: " ".join("w" + letters(x) for x in rng.integers(0, 5000, 60)) for k in range(30)}
    texts |= {100: texts[0], 101: texts[0].upper(), 102: texts[1] + " more", 103: texts[2] + " mail a.b@example.org", 104: None, 105: "12 34", 106: ""}
    rows = [(k, t, "en" if k % 2 else "de", "s", None if t is None else len(t)) for k, t in texts.items()] + [(29, texts[29], "en", "s", len(texts[29]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        left[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(left["language"]) == {k for k, t in texts.items() if re.search("[a-z]", t or "", re.I)}
    # one of each group of equal texts, and of texts of near-equal sets of five-word shingles
    assert {texts[k].lower() for k in left["exact"]} == {texts[k].lower() for k in left["language"]} and len(left["exact"]) == len(left["language"]) - 2
    assert len({0, 100, 101} & set(left["near"])) == len({1, 102} & set(left["near"])) == len({2, 103} & set(left["near"])) == 1
    assert set(range(3, 30)) <= set(left["near"]) and len(left["near"]) == 30
    for k, r in left["private"].items():
        assert r["text"] == (texts[k].replace("a.b@example.org", "[EMAIL]")) and r["n_chars"] == len(r["text"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces if p["doc_id"] is not None} == set(left["near"])


def test_exact_stage_tells_rows_of_an_id_apart(spark, tmp_path):
    """Of an id with two texts only the repeated one goes, and so does a repeated text without id; names may clash."""
    rows = [(5, "same text", "en"), (5, "a text of its own", "en"), (7, "Same text", "en"), (None, "same text", "en"), (None, "no id", None)]
    docs = spark.createDataFrame([(k, t, lang, "s", 1, 0, 0) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _digest int")
    left = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(5, "a text of its own"), (7, "Same text"), (None, "no id")}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, class int, part int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
