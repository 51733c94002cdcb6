"""Files of other tools' layout: compressed chunk files with frames, .npy/.refs parts and the manifest that names them.

Python workers write these files themselves (Spark's writers can't name them), first under a temporary name, so that a task
that runs again leaves whole files. A chunk is streamed: no more than a frame of it is in memory.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import ROW_BITS, word_names
from ..functions.text import tab_field
from ..operators.database import CATALOG, KEYS, Database, part_path
from ..session import file_system, importable
from .native import bytes_of, read_npy

#: Bytes of text from which a frame ends; the level of compression.
FRAME_BYTES = 8 * 524288
LEVEL = 19
#: Bytes and lines of small frames that are read into one batch.
BATCH_BYTES, BATCH_LINES = 1 << 20, 10_000
#: The greatest reference that .refs files can hold.
U32 = (1 << 32) - 1
MANIFEST = "chunk_id long, npy string, refs string, zst string, frames string, onbits int, size long"
WRITTEN = "chunk_id long, path string, lines long, offsets array<long>"


class _Chunk:
    """A chunk file as it is written: whole lines in frames (zstd) or one stream (gzip)."""

    def __init__(self, out_dir: str, name: str, codec: str, frame_bytes: int, level: int):
        self.fs, top = file_system(out_dir)
        self.path, self.name, self.codec, self.frame_bytes = f"{top}/{name}", name, codec, frame_bytes
        self.fs.create_dir(top if "/" not in name else self.path.rsplit("/", 1)[0], recursive=True)
        self.file = self.fs.open_output_stream(f"{self.path}.tmp", compression=None)
        self.gzip = zlib.compressobj(6, zlib.DEFLATED, 31) if codec == "gzip" else None
        self.zstd = None if self.gzip else zstandard.ZstdCompressor(level=level)
        self.lines, self.size, self.buffer, self.held, self.offsets = 0, 0, [], 0, []

    def add(self, line: str) -> None:
        data = line.encode() + b"\n"
        self.buffer.append(data)
        self.held += len(data)
        self.lines += 1
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            body = b"".join(self.buffer)
            packed = self.gzip.compress(body) if self.gzip else self.zstd.compress(body)
            self.offsets.append(self.size)
            self.size += len(packed)
            self.file.write(packed)
            self.buffer, self.held = [], 0

    def close(self, chunk_id: int, out_dir: str) -> tuple:
        self.flush()
        if self.gzip:
            self.file.write(self.gzip.flush())
        self.file.close()
        self.fs.move(f"{self.path}.tmp", self.path)
        return chunk_id, f"{out_dir.rstrip('/')}/{self.name}", self.lines, [] if self.gzip else self.offsets


def write_chunks(rows: DataFrame, out_dir: str, name: Column | None = None, codec: str = "zstd", frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """One file a chunk of rows (chunk_id, line_no, line), in line order: chunk_id, path, lines, offsets (of frames).

    name is the file's name, by default chunk_<id>.zst or chunk_<id>.gz. The files are written now; the result has a row a chunk.
    """
    if codec not in ("zstd", "gzip"):
        raise ValueError(f"unknown codec {codec!r}")
    spark = rows.sparkSession
    importable(spark)
    default = F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"), F.lit(".zst" if codec == "zstd" else ".gz"))
    dealt = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("line_no").cast("long").alias("line_no"), "line", (default if name is None else name).alias("name"))
    dealt = dealt.repartition("chunk_id").sortWithinPartitions("chunk_id", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, done = None, None, []
        for batch in batches:
            for chunk_id, line, file_name in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "line", "name")), strict=True):
                if chunk_id != now:
                    if chunk:
                        done.append(chunk.close(now, out_dir))
                    now, chunk = chunk_id, _Chunk(out_dir, file_name, codec, frame_bytes, level)
                chunk.add(line)
        if chunk:
            done.append(chunk.close(now, out_dir))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["chunk_id", "path", "lines", "offsets"])

    return spark.createDataFrame(dealt.mapInArrow(run, WRITTEN).toArrow())  # a row a file


def _frames(content: bytes, decompressor: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The frames' texts. Input is given in pieces, as what a frame leaves of one is copied: small frames must not copy the file each."""
    view, at = memoryview(content), 0
    while at < len(view):
        part, body, step = decompressor.decompressobj(), [], 1024
        while at < len(view) and not part.eof:
            piece = view[at : at + step]
            body.append(part.decompress(piece))
            at, step = at + len(piece) - len(part.unused_data), min(2 * step, 1 << 20)
        yield b"".join(body)


def read_frames_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no (from 1), ref, line of framed zstd files; empty lines have numbers too.

    More rows in a frame than a reference's bits can name are an error. Frames have no bound here, where a reference is a
    long; export() holds those that it packs against 32 bits."""
    importable(spark)
    files = spark.read.format("binaryFile").load(path).select(plain_path(F.col("path")).alias("path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                before, held, refs, found = 0, 0, [], []
                for frame, body in enumerate(_frames(content, decompressor)):
                    lines = [line.rstrip("\r") for line in body.decode("utf-8", "replace").removesuffix("\n").split("\n")] if body else []
                    if len(lines) > 1 << ROW_BITS:
                        raise ValueError(f"{name} has more rows in a frame than a reference can name")
                    refs.append(np.arange(len(lines), dtype=np.int64) | frame << ROW_BITS)
                    found += lines
                    held += len(body)
                    if held >= BATCH_BYTES or len(found) >= BATCH_LINES:
                        yield _lines_batch(name, before, refs, found)
                        before, held, refs, found = before + len(found), 0, [], []
                if found:
                    yield _lines_batch(name, before, refs, found)

    return files.mapInArrow(run, "path string, line_no long, ref long, line string")


def _lines_batch(name: str, before: int, refs: list[np.ndarray], found: list[str]) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(before + 1, before + n + 1)), pa.array(np.concatenate(refs)), pa.array(found, pa.string())], ["path", "line_no", "ref", "line"])


def plain_path(path: Column) -> Column:
    """A local file's URI as a path; other URIs stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def export(rows: DataFrame, bits: int, chunks: DataFrame, out_dir: str) -> DataFrame:
    """Write .npy and .refs parts, .frames files and manifest.csv of placed rows (chunk_id, onbits, part, position, ref, words).

    chunks is what write_chunks() gave. The manifest: chunk_id, npy, refs, zst, frames, onbits, size. A part has at most
    a million rows (see with_positions), which bounds a group. A reference of over 32 bits is an error.
    """
    spark = rows.sparkSession
    importable(spark)
    names = word_names(bits)
    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("size")).withColumn("parts", F.max("part").over(Window.partitionBy("chunk_id", "onbits")) + 1)
    named = rows.join(sizes.select(*KEYS, part_path(bits).alias("npy")), KEYS).select(*KEYS, "position", "ref", "npy", *names)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        name, found = table.column("npy")[0].as_py(), table.column("ref").to_numpy()
        if found.min() < 0 or found.max() > U32:
            raise ValueError(f"{name} has rows past the frames that a reference can name")
        out = io.BytesIO()
        np.lib.format.write_array(out, np.ascontiguousarray(bytes_of(np.stack([table.column(n).to_numpy() for n in names], 1), bits)), version=(2, 0))
        refs = name.removesuffix(".npy") + ".refs"
        write_file(out_dir, name, out.getvalue())
        write_file(out_dir, refs, found.astype("<u4").tobytes())
        return pa.table({"chunk_id": table.column("chunk_id")[:1], "npy": [f"{out_dir}/{name}"], "refs": [f"{out_dir}/{refs}"], "onbits": table.column("onbits")[:1], "size": pa.array([len(table)], pa.int64())})

    parts = named.groupBy(*KEYS).applyInArrow(pack, "chunk_id long, npy string, refs string, onbits int, size long").toArrow()  # a row a file
    for row in chunks.collect():  # a row a file
        write_file(out_dir, f"chunk_{row['chunk_id']}.frames", np.array(row["offsets"], "<u8").tobytes())
    zst = chunks.select("chunk_id", F.col("path").alias("zst"), F.concat(F.lit(f"{out_dir}/chunk_"), F.col("chunk_id").cast("string"), F.lit(".frames")).alias("frames"))
    out = spark.createDataFrame(parts, "chunk_id long, npy string, refs string, onbits int, size long").join(zst, "chunk_id").select("chunk_id", "npy", "refs", "zst", "frames", "onbits", "size").orderBy("chunk_id", "onbits", "npy")
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).option("header", True).csv(f"{out_dir}/manifest")


def write_file(out_dir: str, name: str, content: bytes) -> None:
    fs, top = file_system(out_dir)
    path = f"{top}/{name}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.tmp", compression=None) as file:
        file.write(content)
    fs.move(f"{path}.tmp", path)


def import_database(spark: SparkSession, manifest_path: str, bits: int, max_files: int | None = None) -> Database:
    """The database that a manifest of other tools names: .npy parts, and payload by .refs in framed chunk files.

    The manifest's order is the order of parts; it has a row a file, and is numbered on the driver."""
    listed = [row.asDict() for row in spark.read.schema(MANIFEST).option("header", True).csv(manifest_path).withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(max_files if max_files is not None else 2**31 - 1).collect()]
    if not listed:
        raise ValueError(f"{manifest_path} names no files")
    start, rows = 0, []
    for k, row in enumerate(listed):
        rows.append((k, row["chunk_id"], row["onbits"], 0, row["npy"], row["size"], start, start + row["size"]))
        start += row["size"]
    catalog = spark.createDataFrame(rows, CATALOG)
    names = F.broadcast(spark.createDataFrame([(k, r["chunk_id"], _plain(r["npy"]), _plain(r["refs"]), _plain(r["zst"]), r["onbits"]) for k, r in enumerate(listed)], "chunk_idx long, chunk_id long, npy string, refs string, zst string, onbits int"))  # a row a file
    fp = read_npy(spark, [r["npy"] for r in listed], bits).drop("onbits").withColumn("path", plain_path(F.col("path")))
    fp = fp.join(names, F.col("path") == F.col("npy")).select("chunk_idx", "chunk_id", "onbits", F.lit(0).cast("long").alias("part"), "position", *word_names(bits))
    refs = spark.read.format("binaryFile").load([r["refs"] for r in listed]).select(plain_path(F.col("path")).alias("path"), "content")
    importable(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = np.frombuffer(content, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found)], ["path", "position", "ref"])

    refs = refs.mapInArrow(unpack, "path string, position long, ref long").join(names, F.col("path") == F.col("refs")).select("chunk_idx", "chunk_id", "onbits", "position", "zst", "ref")
    lines = read_frames_lines(spark, sorted({r["zst"] for r in listed})).select(F.col("path").alias("zst"), "ref", "line")
    payload = refs.join(lines, ["zst", "ref"]).select("chunk_idx", "chunk_id", "onbits", F.lit(0).cast("long").alias("part"), "position", tab_field(F.col("line"), 0).alias("smiles"), F.coalesce(tab_field(F.col("line"), 1), F.lit("")).alias("compound_id"))
    return Database(bits, fp, catalog, payload)


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def write_raw_scores(scores: DataFrame, out_dir: str) -> DataFrame:
    """Scores (gid, score) as raw bytes in global order: files scores-<first id>.u8, which joined by name are one byte a row.

    Ranges of ids are dealt to tasks, and a task streams its own. The result has a row a file: path, start, size.
    """
    spark = scores.sparkSession
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path = fs = start = None
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                start = batch.column("gid")[0].as_py()
                fs, top = file_system(out_dir)
                fs.create_dir(top, recursive=True)
                path = f"{top}/scores-{start:020d}.u8"
                file = fs.open_output_stream(f"{path}.tmp", compression=None)
            file.write(batch.column("score").to_numpy().astype(np.uint8).tobytes())
            size += batch.num_rows
        if file is not None:
            file.close()
            fs.move(f"{path}.tmp", path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{out_dir.rstrip('/')}/{path.rsplit('/', 1)[-1]}"]), pa.array([start], pa.int64()), pa.array([size], pa.int64())], ["path", "start", "size"])

    dealt = scores.select("gid", "score").repartitionByRange("gid").sortWithinPartitions("gid")
    return spark.createDataFrame(dealt.mapInArrow(run, "path string, start long, size long").toArrow())  # a row a file


def read_raw_scores(spark: SparkSession, out_dir: str) -> DataFrame:
    """(gid, score) of the files of write_raw_scores()."""
    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "scores-*.u8").load(out_dir).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, start = np.frombuffer(content, np.uint8), int(name.rsplit("-", 1)[-1].removesuffix(".u8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(found), dtype=np.int64)), pa.array(found.astype(np.int32))], ["gid", "score"])

    return files.mapInArrow(run, "gid long, score int")
