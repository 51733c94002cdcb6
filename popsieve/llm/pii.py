"""Op 5. PII: fixed patterns as seeds of bootstrapped contextual extraction. [native]

Base spans are leftmost, non-overlapping matches per kind; matches that fail their rule are dropped without
retries. A match's place is the running length of the gaps and matches before it (the text split at the
pattern, and the matches), summed in blocks.

Contexts are of two sorts. Labels are a word or two before `:`, `=` or `#`, and their instances the values that
follow: a whole run of digits, blanks and punctuation, or all up to a blank, of any length. Contexts of prose
are the one to BESIDE words left or right of a base span, a run of digits or a word with an `@` anywhere; what
else stands there, plain words too, are instances as well. The graph
of contexts and distinct values over the whole corpus is scored in ROUNDS: a context's confidence in a kind
is s / (s + misfits), where s sums the scores of its values (base spans score 1), SUPPORT at least, and misfits
are its values of another kind or like no identifier; what is merely unseen counts for neither. A value's
score is that of its most confident context. Values in contexts of CONFIDENCE or more become spans of that kind
unless they overlap a base span: with an `@` (email), with three digits or more after a label, or in prose with
the length of a phone or card number that is no date. Of overlapping ones the first stays. Base spans stay.

The patterns are written so that Java matches them without recursion or retrying runs, whatever the text's
length; the tests hold them against the plain ones. Null text counts as empty, an empty table gives no rows,
rows that repeat are scanned each for itself, and no other column is read. Ties between kinds go to
the kind listed first. Only hashes of (context, value) pairs shuffle, made distinct before they do. Plain words
are counted (by mergeable sketches, to a few per cent) only in contexts that their other values leave within
reach of CONFIDENCE; the rest could not be trusted in any round. Texts never shuffle while at most IN_ROW contexts
are trusted: these are looked up inside the row. Spans are compared pairwise within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # domain: no two dots in a row, one at least, none at either end
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?:[A-Za-z0-9.-](?<!\.\.))*[A-Za-z0-9-])?",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # digits, with at most one blank or hyphen between two of them
    "card": r"(?<![0-9])[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap signs that a text may have a match.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LABEL = r"(?<![\p{L}\p{N}_-])[_-]*+\p{L}[\p{L}_-]++(?:\x20\p{L}++)?+\x20{0,2}[:=#]\x20{0,2}(?=[^\s,;:=#])"
#: What follows a label: a run of digits, blanks and punctuation and what hangs on to its last digit, or all up to a blank.
VALUE = r"^(?:[(+]{0,2}[0-9][0-9().\x20/-]*[0-9][^\s,;]*+|[^\s,;]++)"
#: Runs of digits, blanks and punctuation, and words with an `@`, wherever they stand.
NUMBER = r"(?=[(+0-9])(?<![\p{L}\p{N}])[(+]{0,2}[0-9](?:[0-9().\x20/-]*[0-9])?(?![\p{L}\p{N}])"
CANDIDATE = NUMBER + r"""|(?<![^\s,;<>()\[\]{}"'])[^\s,;<>()\[\]{}"'@]++@[^\s,;<>()\[\]{}"']++"""
#: A context of prose is up to so many words beside a value, within so many characters.
BESIDE, NEAR = 3, 120
APART = r"[^\p{L}\p{N}@]+"
#: Digits that make a number in prose look like a phone number or a card; dates don't.
LOOKS = {"phone": (7, 15), "card": (12, 19)}
DATE = r"^(?:(?:19|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:19|20)?[0-9]{2})(?![0-9])"
#: Contexts that are broadcast at most (8 bytes each, or 50 with counts); beyond, the join shuffles.
BROADCAST_CONTEXTS = 1_000_000
#: Trusted contexts that are looked up inside the row at most; beyond, a join by row gives the same spans.
IN_ROW = 4096
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.8
BLOCK = 256
SPAN = "array<struct<kind:int,start:int,end:int>>"


def running(values: Column, first: Column) -> Column:
    """first, first + v1, first + v1 + v2 ... of a short array."""
    return F.aggregate(values, F.array(first), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))


def offsets(lengths: Column) -> Column:
    """The sum of the lengths before each element, in blocks so that long arrays cost little more than their length."""
    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, v: a + v))
    starts = running(sums, F.lit(0))
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda block, start: F.slice(running(block, start), F.lit(1), F.size(block))))


def found(text: Column, pattern: str, sign: str) -> Column:
    """array<struct<start, value>> of the pattern's matches, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    sizes = F.transform(matches, lambda m: F.length(m))
    before = offsets(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), sizes, lambda g, m: g + m))
    starts = F.zip_with(before, F.slice(gaps, F.lit(1), F.size(matches)), lambda b, g: b + g)
    spans = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), m.alias("value")))
    return F.when(text.rlike(sign), spans).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass: from the right, every second one doubled and its digits summed."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    parts = F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda c, i: part(c, i + 1))
    return F.aggregate(parts, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans by kind as listed, then start."""

    def of(number: int, kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind], SIGNS[kind]), lambda s: valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end")))

    return F.concat(*(of(number, kind) for number, kind in enumerate(KINDS))).cast(SPAN)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x20.!?)\]}\"'>(+/-]+$", "")


def labelled(text: Column) -> Column:
    """array<struct<label, value, start, end>> of the values after labels, whatever their length."""
    sign = r"[:=#](?<=\p{L}\x20{0,2}[:=#])"
    matches = found(text, LABEL, sign)
    tails = F.slice(F.split(text, LABEL, -1), F.lit(2), F.greatest(F.size(matches), F.lit(0)))

    def item(m: Column, tail: Column) -> Column:
        start = m["start"] + F.length(m["value"])
        near = F.regexp_extract(tail, VALUE, 0)
        # a value that reaches the next label may go on in it
        value = trimmed(F.when(F.length(near) < F.length(tail), near).otherwise(F.regexp_extract(F.substring(text, start + 1, F.length(text)), VALUE, 0)))
        return F.struct(F.lower(F.regexp_replace(m["value"], r"\x20+", " ")).alias("label"), F.lower(value).alias("value"), start.alias("start"), (start + F.length(value)).alias("end"))

    values = F.filter(F.zip_with(matches, tails, item), lambda s: s["end"] > s["start"])
    return F.when(text.rlike(sign), values).otherwise(F.array().cast("array<struct<label:string,value:string,start:int,end:int>>"))


def _with_kind(items: Column, base: Column, text: Column) -> Column:
    """Of each labelled value: the kind of the base span that starts there (-1: none), and whether any overlaps it.

    Where a base span starts, the value is that span, blanks and all; before a later one it ends."""

    def cut(s: Column) -> Column:
        later = F.array_min(F.transform(F.filter(base, lambda b: (b["start"] > s["start"] + 1) & (b["start"] < s["end"]) & s["value"].rlike("^[(+0-9]")), lambda b: b["start"]))
        value = F.when(later.isNull(), s["value"]).otherwise(trimmed(F.substring(s["value"], F.lit(1), later - s["start"])))
        return F.struct(s["label"].alias("label"), value.alias("value"), s["start"].alias("start"), F.when(later.isNull(), s["end"]).otherwise(s["start"] + F.length(value)).alias("end"))

    def item(s: Column) -> Column:
        same = F.filter(base, lambda b: (b["start"] >= s["start"]) & (b["start"] <= s["start"] + 1))
        over = F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        first = F.get(same, 0)
        value = F.when(F.size(same) > 0, F.lower(F.substring(text, first["start"] + 1, first["end"] - first["start"]))).otherwise(s["value"])
        return F.struct(s["label"].alias("label"), value.alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.when(F.size(same) > 0, first["kind"]).otherwise(F.lit(-1)).alias("kind"), over.alias("over"))

    return F.transform(F.transform(items, cut), item)


def bit(kind: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), kind)


def fitting(kind: Column, value: Column, prose: Column) -> Column:
    """The kinds, as bits, that a value may be of: its own if a base span, else by its look; 0 is like no identifier.

    No label says what a number in prose is, so it takes the length of a phone or card number."""
    email, others = 1 << KINDS.index("email"), sum(1 << k for k, name in enumerate(KINDS) if name != "email")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    bare = sum((F.when(digits.between(*LOOKS[name]), 1 << KINDS.index(name)).otherwise(0) for name in LOOKS), F.lit(0))
    look = F.when(value.contains("@"), email).when(prose, F.when(value.rlike(DATE), 0).otherwise(bare)).when(digits >= 3, others).otherwise(0)
    return F.when(kind >= 0, bit(kind)).otherwise(look)


def contexts(side: str, nearest: list[Column]) -> list[Column]:
    """Hashes of the one to BESIDE words on a side, nearest first; null where there are fewer."""
    return [F.when(nearest[n].isNotNull(), F.xxhash64(F.lit(side), *nearest[: n + 1])) for n in range(BESIDE)]


def beside(text: Column, start: Column, end: Column) -> Column:
    """Hashes of the contexts on both sides of a span. A word that NEAR characters cut through is none."""
    before = F.split(F.lower(F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))), APART)
    before = F.filter(F.reverse(F.when(start > NEAR, F.slice(before, F.lit(2), F.lit(NEAR))).otherwise(before)), lambda w: w != "")
    right = F.substring(text, end + 1, F.lit(NEAR))
    after = F.split(F.lower(right), APART)
    after = F.filter(F.when(F.length(right) == NEAR, F.slice(after, F.lit(1), F.size(after) - 1)).otherwise(after), lambda w: w != "")
    return F.array_compact(F.array(*contexts("left", [F.get(before, k) for k in range(BESIDE)]), *contexts("right", [F.get(after, k) for k in range(BESIDE)])))


def in_prose(text: Column, base: Column) -> Column:
    """array<struct<value, start, end, kind>> of the base spans and all candidates that overlap none."""
    seeds = F.transform(base, lambda b: F.struct(F.lower(F.substring(text, b["start"] + 1, b["end"] - b["start"])).alias("value"), b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))

    def item(m: Column) -> Column:
        later = F.array_min(F.transform(F.filter(base, lambda b: (b["start"] > m["start"]) & (b["start"] < m["start"] + F.length(m["value"]))), lambda b: b["start"]))
        value = trimmed(F.when(later.isNull(), m["value"]).otherwise(F.substring(m["value"], F.lit(1), later - m["start"])))
        return F.struct(F.lower(value).alias("value"), m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), F.lit(-1).alias("kind"))

    places = F.when(text.contains("@"), found(text, CANDIDATE, "@")).otherwise(found(text, NUMBER, "[0-9]"))
    free = F.filter(F.transform(places, item), lambda s: (s["end"] > s["start"]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.concat(seeds, free)


def plain(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, words): how many distinct plain words stand in each of the wanted contexts, to a few per cent.

    Every word of every text is held against the contexts, so this runs on generated code alone: each word with its
    neighbours is a row, and the counts are mergeable sketches, of which a task shuffles one a context."""
    words = texts.select(F.array_remove(F.split(F.lower("_text"), APART), "").alias("_w"))
    pad = F.array_repeat(F.lit(None).cast("string"), BESIDE)
    words = words.select(F.concat(pad, "_w", pad).alias("_w"))
    rows = words.select(F.inline(F.arrays_zip(*(F.slice("_w", F.lit(k + 1), F.size("_w")) for k in range(2 * BESIDE + 1)))))
    rows = rows.toDF(*(f"_{k}" for k in range(2 * BESIDE + 1))).where(F.col(f"_{BESIDE}").isNotNull())
    left, right = ([F.col(f"_{BESIDE + step * (n + 1)}") for n in range(BESIDE)] for step in (-1, 1))
    rows = rows.select(F.col(f"_{BESIDE}").alias("_word"), F.explode(F.array(*contexts("left", left), *contexts("right", right))).alias("label"))
    rows = rows.join(wanted, "label").where(~F.col("_word").rlike("[0-9@]"))
    return rows.groupBy("label").agg(F.approx_count_distinct("_word").alias("words"))


def confidence(s: Column, misfits: Column) -> Column:
    return s / (s + misfits)


def within_reach(counts: DataFrame) -> Column:
    """Whether a context could be trusted in some kind if all its fitting values scored 1; others never will be."""
    able = F.lit(False)
    for k in range(len(KINDS)):
        fits = F.get("fitting", k)
        able = able | ((fits >= SUPPORT) & (confidence(fits, F.get("misfits", k)) >= CONFIDENCE))
    return able


def weighed(edges: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, misfits array by kind) of the contexts that may come to be trusted; plain words count for those of prose."""

    def by_kind(fits: bool) -> Column:
        return F.array(*(F.count_if((F.col("fits").bitwiseAND(1 << k) != 0) == F.lit(fits)) for k in range(len(KINDS))))

    counts = edges.groupBy("label").agg(by_kind(True).alias("fitting"), by_kind(False).alias("misfits"), F.max("prose").alias("prose"))
    counts = scratch.written(counts.where(within_reach(counts)), "pii-contexts")
    wanted = counts.where("prose").select("label")
    n = wanted.count()
    if not n:
        return counts.select("label", "misfits")
    words = plain(texts, F.broadcast(wanted) if n <= BROADCAST_CONTEXTS else wanted)
    counts = counts.join(words, "label", "left").withColumn("misfits", F.transform("misfits", lambda m: m + F.coalesce("words", F.lit(0))))
    return scratch.written(counts.where(within_reach(counts)).select("label", "misfits"), "pii-weighed")


def accepted(edges: DataFrame, misfits: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, kind, confidence) to trust, from distinct rows (label, value, kind, fits): a graph of contexts and values."""
    seeds = edges.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for turn in range(ROUNDS):
        labels = edges.join(scores.withColumnRenamed("kind", "as"), "value").where(F.col("fits").bitwiseAND(bit(F.col("as"))) != 0)
        labels = labels.groupBy("label", F.col("as").alias("kind")).agg(F.sum("score").alias("s")).where(F.col("s") >= SUPPORT).join(misfits, "label")
        labels = labels.withColumn("confidence", confidence(F.col("s"), F.get("misfits", F.col("kind"))))
        labels = scratch.written(labels.where(F.col("confidence") >= CONFIDENCE).select("label", "kind", "confidence"), "pii-labels")
        if turn == ROUNDS - 1:
            break
        fresh = edges.where("kind < 0").select("label", "value", "fits").join(labels, "label").where(F.col("fits").bitwiseAND(bit(F.col("kind"))) != 0)
        fresh = fresh.groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        scores = scratch.written(seeds.unionByName(fresh).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-values")
    return labels


def trusted_contexts(table: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The accepted contexts of the corpus. Edges are made distinct before they shuffle; only contexts that can
    be accepted go through the rounds."""
    items = table.select(F.explode("_items").alias("_")).select("_.*").withColumn("label", F.explode("labels"))
    edges = items.groupBy("label", "value").agg(F.max("kind").alias("kind"), F.max_by("fits", "kind").alias("fits"), F.max("prose").alias("prose"))
    edges = scratch.written(edges, "pii-edges")
    misfits = weighed(edges, texts, scratch)
    few = F.broadcast(misfits) if misfits.count() <= BROADCAST_CONTEXTS else misfits
    edges = scratch.written(edges.drop("prose").join(few.select("label"), "label", "left_semi"), "pii-graph")
    return accepted(edges, misfits, scratch)


def apart(spans: Column) -> Column:
    """Spans without those that overlap an earlier or, from one start, longer one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["_end"]).alias("end"))
        return F.struct(F.when(fresh, -s["_end"]).otherwise(done["at"]).alias("at"), F.when(fresh, F.concat(done["out"], F.array(span).cast(SPAN))).otherwise(done["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda done: done["out"])


def new_in_row(trusted: list) -> Column:
    """The new spans of a row's items by trusted contexts (label, kind, confidence) that stand in the plan."""

    def sure(labels: Column, known: dict) -> Column:
        """The most confident of a kind's contexts; null if there is none."""
        of = F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values())))
        return F.array_max(F.transform(F.filter(labels, lambda label: label.isin(list(known))), lambda label: F.element_at(of, label)))

    def kind(s: Column) -> Column:
        """The kind of the most confident context; ties go to the kind listed first."""
        votes = []
        for k in range(len(KINDS)):
            known = {row["label"]: row["confidence"] for row in trusted if row["kind"] == k}
            if known:
                votes.append(F.struct(F.when(s["fits"].bitwiseAND(1 << k) != 0, sure(s["labels"], known)).alias("confidence"), F.lit(-k).alias("kind")))
        best = F.array_max(F.array(*votes))
        return F.when(best["confidence"].isNotNull(), -best["kind"])

    free = F.filter("_items", lambda s: ~s["over"] & (s["fits"] != 0))
    of_kind = F.transform(free, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return apart(F.filter(of_kind, lambda s: s["kind"].isNotNull()))


def new_by_join(table: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_row, _new): the same by a join, for any number of trusted contexts."""
    items = table.select("_row", F.explode(F.filter("_items", lambda s: ~s["over"] & (s["fits"] != 0))).alias("_")).select("_row", "_.*")
    new = items.select("_row", "start", "end", "fits", F.explode("labels").alias("label")).join(trusted, "label").where(F.col("fits").bitwiseAND(bit(F.col("kind"))) != 0)
    new = new.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return new.groupBy("_row").agg(apart(F.collect_list(F.struct("kind", "start", "end"))).alias("_new"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base, spans (arrays of kind number, start, end; by kind, then start) and the columns in `keep`."""
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = rows.select("_text")
    rows = rows.withColumn("base", base_spans(F.col("_text"))).withColumn("_items", _with_kind(labelled(F.col("_text")), F.col("base"), F.col("_text"))).withColumn("_prose", in_prose(F.col("_text"), F.col("base"))).withColumn("_row", F.monotonically_increasing_id())

    def item(s: Column, prose: bool, labels: Column, over: Column) -> Column:
        fits = fitting(s["kind"], s["value"], F.lit(prose))
        return F.struct(labels.alias("labels"), F.xxhash64(s["value"]).alias("value"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), over.alias("over"), fits.alias("fits"), F.lit(prose).alias("prose"))

    of_labels = F.transform("_items", lambda s: item(s, False, F.array(F.xxhash64(F.lit("label"), s["label"])), s["over"]))
    of_prose = F.transform("_prose", lambda s: item(s, True, beside(F.col("_text"), s["start"], s["end"]), s["kind"] >= 0))
    table = kept.written(rows.withColumn("_items", F.concat(of_labels, of_prose)).drop("_text", "_prose"), "pii-spans")
    trusted = trusted_contexts(table, texts, scratch)
    if trusted.count() <= IN_ROW:
        known = trusted.orderBy("label", "kind").collect()  # IN_ROW rows at most
        scratch.drop()
        new = table.withColumn("_new", new_in_row(known) if known else F.array().cast(SPAN))
    else:
        new = table.join(new_by_join(table, kept.written(trusted, "pii-trusted")), "_row", "left")
        scratch.drop()
    spans = F.array_sort(F.concat("base", F.coalesce("_new", F.array()).cast(SPAN)))
    return new.select("doc_id", *keep, "base", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        fresh = s["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(done["out"]).alias("out"))

    out = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def digest(spans: DataFrame) -> DataFrame:
    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *(count(number, kind) for number, kind in enumerate(KINDS)), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op5_pii(spark, sf_dir):
    return digest(find_pii(documents(spark, sf_dir)))
