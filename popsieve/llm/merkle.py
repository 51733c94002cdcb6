"""Op 3. Document fingerprints: a Merkle tree over sections and paragraphs. [native]

Sections are split at empty lines, paragraphs at line ends; a paragraph's leaves are its runs of LEAF_WORDS words,
each a 24-bit hash. A paragraph's node is the hash of its text, a section's that of its paragraphs' nodes,
the root that of the sections' nodes, so roots are equal just where texts are, and unequal nodes lead
down to what was edited. The fingerprint spells the tree:

    root/section-paragraph.leaves-paragraph.leaves/section...

Likeness is 1 for equal roots, else the Dice coefficient of the sets of leaves. All of it is built-in
functions on whole texts.

next_texts() gives each row the next document's text by ascending id. Ids are dealt into ranges of about
PART_ROWS rows by quantiles, and quantiles of what lies between them, that are read from the ids alone, so ids may
lie as unevenly as they like; of a table over PART_ROWS * QUANTILES ** LEVELS rows (a thousand million) a range is a
two-millionth. The texts shuffle once, by range; and a
boundary record, the first document of the next range, closes each range. Rows that share an id lie in one range, in
order of their text. A null id has no place in the order: it is followed by the empty text.
Null text counts as empty. A table of one document is followed by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, written

LEAF_WORDS = 4
LEAVES = rf"\s*+(?:\S++\s*+){{1,{LEAF_WORDS}}}+|\s++"
#: Parts that a range is cut into at once, and how often; the last cut's edges, which are broadcast, are QUANTILES ** LEVELS
#: numbers at most (17 MB). Rows of a range (about); boundary ids broadcast at most.
QUANTILES, LEVELS, ACCURACY = 128, 3, 1024
PART_ROWS = 512
BROADCAST_IDS = 1_000_000


def tree(text: Column) -> Column:
    """array<section: array<paragraph: struct<node, leaves array<int>>>>."""

    def leaf(run: Column) -> Column:
        return F.xxhash64(run).bitwiseAND(F.lit(0xFFFFFF)).cast("int")

    def paragraph(line: Column) -> Column:
        return F.struct(F.md5(line).alias("node"), F.transform(F.regexp_extract_all(line, F.lit(LEAVES), F.lit(0)), leaf).alias("leaves"))

    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), paragraph))


def section_nodes(tree: Column) -> Column:
    return F.transform(tree, lambda section: F.md5(F.array_join(F.transform(section, lambda p: p["node"]), ",")))


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(section_nodes(tree), "/"), 256)


def leaves(tree: Column) -> Column:
    """The set of leaves as an array."""
    return F.array_distinct(F.flatten(F.transform(tree, lambda section: F.flatten(F.transform(section, lambda p: p["leaves"])))))


def spelled(tree: Column) -> Column:
    def hexed(leaf: Column) -> Column:
        return F.substring(F.hex(leaf.cast("long") + F.lit(1 << 24)), 2, 6)

    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["node"], 1, 8), F.lit("."), F.lower(F.array_join(F.transform(p["leaves"], hexed), "")))

    sections = F.zip_with(section_nodes(tree), tree, lambda node, section: F.concat(F.substring(node, 1, 8), F.lit("-"), F.array_join(F.transform(section, paragraph), "-")))
    return F.concat(root(tree), F.lit("/"), F.array_join(sections, "/"))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    both = F.size(leaves_a) + F.size(leaves_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both)


def parsed(fingerprint: Column) -> Column:
    """struct<root, sections: array<struct<node, paragraphs: array<struct<node, leaves>>>>> of a spelled tree."""
    parts = F.split(fingerprint, "/", -1)

    def paragraph(p: Column) -> Column:
        return F.struct(F.substring(p, 1, 8).alias("node"), F.regexp_extract_all(F.substring(p, F.lit(10), F.length(p)), F.lit("[0-9a-f]{6}"), F.lit(0)).alias("leaves"))

    def section(s: Column) -> Column:
        items = F.split(s, "-", -1)
        return F.struct(F.element_at(items, 1).alias("node"), F.transform(F.slice(items, F.lit(2), F.size(items)), paragraph).alias("paragraphs"))

    return F.struct(F.element_at(parts, 1).alias("root"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), section).alias("sections"))


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Nodes of the paragraphs in `after` (spelled) that lie under sections not in `before` and are new themselves."""
    a, b = parsed(before), parsed(after)
    old_sections = F.transform(a["sections"], lambda s: s["node"])
    old = F.flatten(F.transform(a["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["node"])))
    changed = F.filter(b["sections"], lambda s: ~F.array_contains(old_sections, s["node"]))
    nodes = F.flatten(F.transform(changed, lambda s: F.transform(s["paragraphs"], lambda p: p["node"])))
    return F.when(a["root"] == b["root"], F.array().cast("array<string>")).otherwise(F.array_except(nodes, old))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document; no shuffle."""
    return id_and_text(docs, id_col, text_col).select("doc_id", tree(F.col("text")).alias("tree")).select("doc_id", spelled(F.col("tree")).alias("fingerprint"))


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` with `coarse` (by quantile) and `part` (a range of about PART_ROWS rows), both rising with doc_id."""
    wanted = rows.count() / PART_ROWS
    out = rows.withColumns({"coarse": F.lit(0), "part": F.lit(0).cast("long")})
    for level in range(LEVELS):
        if wanted <= 1:
            break
        splits = min(QUANTILES, math.ceil(wanted))
        quantiles = F.percentile_approx("doc_id", [k / splits for k in range(1, splits)], ACCURACY).alias("_edges")
        if level:
            edges = written(out.groupBy(F.col("part").alias("_part")).agg(quantiles), "range-edges")
            out = out.join(F.broadcast(edges), F.col("part") == F.col("_part")).drop("_part")
        else:
            out = out.withColumn("_edges", F.lit(rows.agg(quantiles).first()[0]))
        inside = F.size(F.filter("_edges", lambda edge: edge < F.col("doc_id")))
        out = out.withColumn("part", F.col("part") * splits + inside).drop("_edges")
        if not level:
            out = out.withColumn("coarse", F.col("part").cast("int"))
        wanted /= splits
    return out


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, next_text, part, last) with a boundary record (last = 1) a range, and the window
    that they are sorted in; drop the boundary records when nothing more looks ahead."""
    texts = id_and_text(docs, id_col, text_col)
    rows = _dealt(texts.where("doc_id is not null"))
    firsts = rows.groupBy("coarse", "part").agg(F.min("doc_id").alias("first"))
    coarse = firsts.groupBy("coarse").agg(F.min("first").alias("first")).withColumn("_first", F.lead("first").over(Window.orderBy("coarse"))).withColumn("_all", F.min("first").over(Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # QUANTILES rows
    ends = firsts.withColumn("_next", F.lead("first").over(Window.partitionBy("coarse").orderBy("part"))).join(F.broadcast(coarse.drop("first")), "coarse")
    ends = written(ends.select("part", F.coalesce("_next", "_first", "_all").alias("doc_id")), "range-ends")
    few = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    boundary = texts.join(few, "doc_id").select("doc_id", "text", F.col("part").cast("long").alias("part"), F.lit(1).alias("last"))
    own = rows.select("doc_id", "text", F.col("part").cast("long").alias("part"), F.lit(0).alias("last"))
    window = Window.partitionBy("part").orderBy("last", "doc_id", "text")
    return own.union(boundary).withColumn("next_text", F.lead("text").over(window)), window


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, window = next_texts(docs, id_col, text_col)
    rows = rows.withColumn("tree", tree(F.col("text"))).withColumn("root", root(F.col("tree"))).withColumn("leaves", leaves(F.col("tree")))
    rows = rows.withColumn("next_root", F.lead("root").over(window)).withColumn("next_leaves", F.lead("leaves").over(window)).where("last = 0")
    lost = id_and_text(docs, id_col, text_col).where("doc_id is null").select("doc_id", "text", F.lit("").alias("next_text"), tree(F.col("text")).alias("tree"))
    lost = lost.select("doc_id", "text", "next_text", "tree", root(F.col("tree")).alias("root"), leaves(F.col("tree")).alias("leaves"), root(tree(F.lit(""))).alias("next_root"), leaves(tree(F.lit(""))).alias("next_leaves"))
    rows = rows.select(*lost.columns).union(lost)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("tree")).alias("fingerprint"),
        spelled(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), root(F.col("edited_tree")), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
    )


def op3_fingerprints(spark, sf_dir):
    return edits(documents(spark, sf_dir))
