"""Fingerprint databases: build, manifest, partitioned storage, lookup.

A row of a database has chunk_idx, position, onbits and the words; its payload lies in a second table and is joined
last. Stored, both are partitioned by onbits and by groups of chunks (chunk_id x onbits would make too many
small files) and sorted by chunk and position, so that a search reads few partitions and a lookup few row groups, and
building some chunks anew rewrites their groups alone. Stored rows are named by (chunk_id, onbits, part, position), which
later builds don't shift; chunk_idx, the ordinal in the manifest, is looked up as they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import ones, word_names
from ..functions.text import tab_field
from ..session import delete, replace
from .chemistry import backend, with_fingerprints

PART_ROWS = 1_000_000
#: Chunks that share a stored folder of each on-bit count.
GROUP_CHUNKS = 64
#: Manifest rows that are broadcast at most (some 50 bytes each).
BROADCAST_PARTS = 1_000_000
KEYS = ["chunk_id", "onbits", "part"]
CATALOG = "chunk_idx long, chunk_id long, onbits int, part long, path string, size long, start long, end long"


def with_positions(rows: DataFrame, bits: int, part_rows: int = PART_ROWS) -> DataFrame:
    """rows (chunk_id, line_no, words, payload): adds onbits, part and position in line order."""
    words = [F.col(w) for w in word_names(bits)]
    if "onbits" not in rows.columns:
        rows = rows.withColumn("onbits", ones(words))
    place = (F.row_number().over(Window.partitionBy("chunk_id", "onbits").orderBy("line_no")) - 1).cast("long")
    return rows.withColumn("_place", place).withColumn("part", (F.col("_place") / part_rows).cast("long")).withColumn("position", F.col("_place") % part_rows).drop("_place")


def part_path(bits: int) -> Column:
    """The name that the manifest sorts by; parts are told apart only where there are several."""
    name = F.concat(F.lit(f"fp_{bits}/chunk_"), F.col("chunk_id").cast("string"), F.lit("_onbits_"), F.col("onbits").cast("string"))
    return F.concat(name, F.when(F.col("parts") > 1, F.concat(F.lit("_part_"), F.col("part").cast("string"))).otherwise(F.lit("")), F.lit(".npy"))


def manifest(rows: DataFrame, bits: int) -> DataFrame:
    """chunk_idx, chunk_id, onbits, part, path, size, start, end: a row per (chunk, onbits, part).

    Sorted by chunk, on-bits and path (as text, so part 10 comes before part 2). It has a row per stored
    part, so the ordinal and running offsets need no distributed window.
    """
    return numbered(rows.groupBy("chunk_id", "onbits", "part").agg(F.count("*").alias("size")), bits)


def numbered(sizes: DataFrame, bits: int) -> DataFrame:
    """The manifest of (chunk_id, onbits, part, size)."""
    sizes = sizes.withColumn("parts", F.max("part").over(Window.partitionBy("chunk_id", "onbits")) + 1).withColumn("path", part_path(bits))
    order = Window.orderBy("chunk_id", "onbits", "path")
    out = sizes.withColumn("chunk_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("chunk_idx", "chunk_id", "onbits", "part", "path", "size", (F.col("end") - F.col("size")).alias("start"), "end")


def few(table: DataFrame, most: int) -> DataFrame:
    """`table`, to be broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def group_of(chunk: Column) -> Column:
    return F.floor(chunk / GROUP_CHUNKS).cast("long")


@dataclass
class Database:
    """fp: chunk_idx, chunk_id, part, position, onbits, words. payload: the same keys, smiles, compound_id; or none."""

    bits: int
    fp: DataFrame
    catalog: DataFrame
    payload: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, bits: int, max_files: int | None = None, part_rows: int = PART_ROWS) -> Database:
        """rows: chunk_id, line_no, words and perhaps smiles, compound_id. A column onbits is taken as it is, else counted."""
        placed = with_positions(rows, bits, part_rows)
        catalog = manifest(placed, bits)
        if max_files is not None:
            catalog = catalog.where(F.col("chunk_idx") < max_files)
        keyed = placed.join(catalog.select("chunk_idx", *KEYS), KEYS)
        payload = keyed.select("chunk_idx", *KEYS, "position", "smiles", "compound_id") if {"smiles", "compound_id"} <= set(rows.columns) else None
        return cls(bits, keyed.select("chunk_idx", *KEYS, "position", *word_names(bits)), catalog, payload)

    @classmethod
    def from_lines(cls, lines: DataFrame, sizes: list[int], make=backend, part_rows: int = PART_ROWS) -> dict[int, Database]:
        """A database of each size from normalized lines (chunk_id, line_no, line: SMILES TAB id); lines whose
        SMILES can't be parsed are left out, and keep their number."""
        rows = lines.select("chunk_id", "line_no", tab_field(F.col("line"), 0).alias("smiles"), F.coalesce(tab_field(F.col("line"), 1), F.lit("")).alias("compound_id")).where("smiles != ''")
        found = with_fingerprints(rows, sizes, make)
        own = {bits: [F.col(f"fp{bits}_{w}").alias(w) for w in word_names(bits)] for bits in sizes}
        return {bits: cls.build(found.select("chunk_id", "line_no", "smiles", "compound_id", *own[bits]), bits, part_rows=part_rows) for bits in sizes}

    def save(self, path: str, only_chunks: list[int] | None = None) -> None:
        """Parquet under path/{fp,payload,manifest}. With only_chunks (chunk ids), what is stored of these chunks goes, their
        rows here take its place, and the manifest is numbered anew; folders without such chunks stay as they are."""
        spark = self.fp.sparkSession
        tables = [(name, table.drop("chunk_idx").withColumn("chunk_group", group_of(F.col("chunk_id")))) for name, table in (("fp", self.fp), ("payload", self.payload)) if table is not None]
        if only_chunks is None:
            for name, table in tables:
                self._write(table, f"{path}/{name}", "static")
            self.catalog.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
            return
        listed = F.col("chunk_id").isin(only_chunks)
        catalog = spark.read.schema(CATALOG).option("header", True).csv(f"{path}/manifest")
        sizes = catalog.where(~listed).unionByName(self.catalog.where(listed)).select(*KEYS, "size")
        numbered(sizes, self.bits).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/manifest-new")
        fresh = spark.read.schema(CATALOG).option("header", True).csv(f"{path}/manifest-new")
        folders = [F.col("onbits"), group_of(F.col("chunk_id")).alias("chunk_group")]
        touched = catalog.where(listed).select(*folders).union(self.catalog.where(listed).select(*folders)).distinct()
        groups = sorted({c // GROUP_CHUNKS for c in only_chunks})
        for name, table in tables:
            old = spark.read.parquet(f"{path}/{name}").where(F.col("chunk_group").isin(groups) & ~listed)
            kept = old.join(F.broadcast(touched), ["onbits", "chunk_group"], "left_semi").select(*table.columns)  # folders of the listed chunks
            self._write(kept.unionByName(table.where(listed)), f"{path}/{name}", "dynamic")
        for folder in touched.join(fresh.select(*folders).distinct(), ["onbits", "chunk_group"], "left_anti").collect():  # folders that have no row left
            for name, _ in tables:
                delete(spark, f"{path}/{name}/onbits={folder['onbits']}/chunk_group={folder['chunk_group']}")
        replace(spark, f"{path}/manifest-new", f"{path}/manifest")

    def _write(self, table: DataFrame, path: str, overwrite: str) -> None:
        order = ["onbits", "chunk_group", "chunk_id", "part", "position"]
        (
            table.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", overwrite)
            .option("maxRecordsPerFile", PART_ROWS)
            .option("compression", "zstd")
            .partitionBy("onbits", "chunk_group")
            .parquet(path)
        )

    @classmethod
    def open(cls, spark: SparkSession, path: str, bits: int, max_files: int | None = None) -> Database:
        """A saved database; its width must be `bits`."""
        fp = spark.read.parquet(f"{path}/fp")
        stored = sorted((c for c in fp.columns if c[:1] == "w" and c[1:].isdigit()), key=lambda c: int(c[1:]))
        if stored != word_names(bits):
            raise ValueError(f"the table has {len(stored)} words; {bits} bits need {len(word_names(bits))}")
        catalog = spark.read.schema(CATALOG).option("header", True).csv(f"{path}/manifest")
        try:
            payload = spark.read.parquet(f"{path}/payload")
        except Exception as error:  # a database without payload
            if "PATH_NOT_FOUND" not in str(error):
                raise
            payload = None
        names = few(catalog.select("chunk_idx", *KEYS), BROADCAST_PARTS)
        db = cls(bits, fp.join(names, KEYS).drop("chunk_group"), catalog, None if payload is None else payload.join(names, KEYS).drop("chunk_group"))
        return db if max_files is None else db.first(max_files)

    def first(self, files: int) -> Database:
        """The database of the manifest's first rows."""
        cut = F.col("chunk_idx") < files
        return Database(self.bits, self.fp.where(cut), self.catalog.where(cut), None if self.payload is None else self.payload.where(cut))

    def __len__(self) -> int:
        return int(self.catalog.agg(F.sum("size")).first()[0] or 0)

    def global_to_chunk_position(self, ids: DataFrame, column: str = "gid") -> DataFrame:
        """ids (column): adds chunk_idx and position; an id out of range is an error.

        Ids are cut into about as many blocks as there are parts, so that this is an equi-join on the block and no nested loop.
        """
        parts = self.catalog.where("size > 0").select("chunk_idx", "start", "end")
        n, size = parts.count(), max(1, len(self))
        width = max(1, size // max(1, n))
        ranges = parts.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))  # at most twice the parts
        ranges = F.broadcast(ranges) if n <= BROADCAST_PARTS else ranges
        keyed = ids.withColumn("_block", F.floor(F.col(column) / width))
        hit = (keyed["_block"] == ranges["_block"]) & (F.col(column) >= F.col("start")) & (F.col(column) < F.col("end"))
        out = keyed.join(ranges, hit, "left").drop("_block")
        index = F.when(F.col("chunk_idx").isNull(), F.raise_error(F.concat(F.lit("no row "), F.col(column).cast("string")))).otherwise(F.col("chunk_idx"))
        return out.select(*ids.columns, index.cast("long").alias("chunk_idx"), (F.col(column) - F.col("start")).alias("position"))

    def lookup(self, wanted: DataFrame, onbits: Column | None = None) -> DataFrame:
        """wanted (chunk_idx, position, any other columns): adds smiles, compound_id.

        Repeats are kept; negative positions count from the chunk's end; a position out of range is an error.
        The rows' on-bits come from the manifest, and the join has them as a key, so that folders which nothing asks for
        can be left out at run time; `onbits`, a condition on them, leaves out more beforehand.
        """
        if self.payload is None:
            raise ValueError("this database has no payload")
        parts = few(self.catalog.select("chunk_idx", F.col("onbits").alias("_onbits"), "size"), BROADCAST_PARTS)
        rows = wanted.join(parts, "chunk_idx", "left")
        place = F.when(F.col("position") < 0, F.col("position") + F.col("size")).otherwise(F.col("position"))
        good = place.between(0, F.col("size") - 1)
        bad = F.raise_error(F.concat(F.lit("position out of range: "), F.col("position").cast("string"))).cast("long")
        rows = rows.withColumn("_at", F.when(good, place).otherwise(bad)).drop("size")
        payload = self.payload if onbits is None else self.payload.where(onbits)
        payload = payload.select(F.col("onbits").alias("_of"), F.col("chunk_idx").alias("_chunk"), F.col("position").alias("_place"), "smiles", "compound_id")
        return rows.join(payload, (F.col("_onbits") == F.col("_of")) & (F.col("chunk_idx") == F.col("_chunk")) & (F.col("_at") == F.col("_place")), "left").drop("_onbits", "_of", "_chunk", "_place", "_at")

    def get_smiles_and_ids_by_ref_indices(self, wanted: dict[int, list[int]]) -> dict[int, list[tuple[str, str]]]:
        """The payload of a few rows, in the order asked for; the request bounds the result."""
        rows = [(int(c), int(p), k) for c, places in wanted.items() for k, p in enumerate(places)]
        out: dict[int, list[tuple[str, str]]] = {int(c): [] for c in wanted}
        if rows:
            asked = self.fp.sparkSession.createDataFrame(rows, "chunk_idx long, position long, ordinal int")
            for row in self.lookup(F.broadcast(asked)).orderBy("chunk_idx", "ordinal").collect():
                out[row["chunk_idx"]].append((row["smiles"], row["compound_id"]))
        return out


DataBase = ZINC = Database
