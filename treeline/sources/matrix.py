"""Binary matrices: little-endian int32 rows n, int32 columns d, then n * d float64, row by row.

``read_matrix`` reads a file, or a folder of files, by any path that Hadoop reads, many tasks a file: records of a fixed
length that divides the file, of which the header is the first word. ``write_parts`` writes a folder of such files from the
tasks. ``spark.read.format("treeline_matrix").load(path)`` is a data source for disks that every executor sees, whose
partitions seek to their own rows; options: ``rows`` and ``dims`` keep a prefix of the rows or coordinates, ``partitionRows``
sets rows per partition. ``write_points`` writes one file to such a disk.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.model import POINTS
from treeline.session import written

HEADER, HEADER_SIZE = "<ii", 8
SCHEMA = pa.schema([pa.field("id", pa.int64(), False), pa.field("coords", pa.list_(pa.field("element", pa.float64(), False)), False)])
PIECES = pa.schema([*SCHEMA, pa.field("place", pa.int32())])
BATCH = 8192
MOST_WORDS = 4096  # of a record, 8 bytes each
CHUNK = 1 << 20


class MatrixError(ValueError):
    """A file that is not a whole matrix, or a prefix that it does not have."""


def header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        head = f.read(HEADER_SIZE)
    if len(head) < HEADER_SIZE:
        raise MatrixError(f"{path}: no header")
    n, d = struct.unpack(HEADER, head)
    if n < 0 or d < 0 or os.path.getsize(path) != HEADER_SIZE + 8 * n * d:
        raise MatrixError(f"{path}: {os.path.getsize(path)} bytes; a matrix of {n} x {d} has {HEADER_SIZE + 8 * n * d}")
    return n, d


def write_matrix(path: str, rows: np.ndarray) -> None:
    rows = np.ascontiguousarray(rows, "<f8")
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, *rows.shape))
        f.write(rows.tobytes())


def write_points(points: DataFrame, path: str) -> None:
    """points(id, coords) of one dimension to a matrix file, rows by id, on a disk that all tasks share.

    Each task writes runs of neighbouring rows at their place; a task that runs again writes the same bytes.
    """
    from treeline.plans.splits import indexed

    rows = indexed(points)
    n, d, most = rows.agg(F.count("*"), F.coalesce(F.min(F.size("coords")), F.lit(0)), F.coalesce(F.max(F.size("coords")), F.lit(0))).first()
    if d != most:
        raise MatrixError(f"{path}: rows of {d} to {most} columns")
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, n, d))
        f.truncate(HEADER_SIZE + 8 * n * d)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for part in filter(len, parts):
                at, flat = part.column("index").to_numpy(), part.column("coords").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(part), -1)
                first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                for k, stop in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                    f.seek(HEADER_SIZE + 8 * d * int(at[k]))
                    f.write(flat[k:stop].tobytes())
                done += len(part)
        yield pa.RecordBatch.from_pydict({"rows": [done]})

    done = rows.select("index", "coords").sortWithinPartitions("index").mapInArrow(run, "rows long").agg(F.sum("rows")).first()[0] or 0
    if done != n:
        raise MatrixError(f"{path}: {done} of {n} rows were written")


def write_parts(points: DataFrame, uri: str, parts: int = 8) -> None:
    """points(id, coords) of one dimension to a new folder of matrix files, together in the order of ids, by any URI that
    ``pyarrow.fs`` writes (file, hdfs, s3, ..). A task that runs again replaces its file by the same one."""
    from treeline.plans.splits import indexed, split_of

    rows = indexed(points)
    n, d, most = rows.agg(F.count("*"), F.coalesce(F.min(F.size("coords")), F.lit(0)), F.coalesce(F.max(F.size("coords")), F.lit(0))).first()
    if d != most:
        raise MatrixError(f"{uri}: rows of {d} to {most} columns")
    folder = hadoop_uri(points.sparkSession, uri)
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(table: pa.Table) -> pa.Table:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        table = table.sort_by("index")
        k, x = table.column("file")[0].as_py(), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("coords").chunks])
        held = f"{path}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(held) as f:
            f.write(struct.pack(HEADER, len(table), d))
            f.write(np.ascontiguousarray(x, "<f8"))
        fs.move(held, f"{path}/part-{k:05d}.bin")
        return pa.table({"rows": [len(table)]})

    done = rows.withColumn("file", split_of(F.col("index"), n, parts)).groupBy("file").applyInArrow(run, "rows long").agg(F.sum("rows")).first()[0] or 0
    if done != n:
        raise MatrixError(f"{uri}: {done} of {n} rows were written")


def hadoop_uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop gives it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def to_batch(first: int, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    coords = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), type=SCHEMA.field("coords").type)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows), dtype=np.int64)), coords], schema=SCHEMA)


class Rows(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.n, self.d = header(self.path)
        self.keep, self.dims = int(options.get("rows", self.n)), int(options.get("dims", self.d))
        if not 0 <= self.keep <= self.n or not 0 <= self.dims <= self.d:
            raise MatrixError(f"{self.path}: {self.keep} x {self.dims} asked of a matrix of {self.n} x {self.d}")
        self.step = max(1, int(options.get("partitionrows", options.get("partitionRows", max(1, (64 << 20) // max(8, 8 * self.d))))))

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.step, self.keep)) for a in range(0, self.keep, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for a in range(partition.start, partition.stop, BATCH):
                k = min(BATCH, partition.stop - a)
                f.seek(HEADER_SIZE + 8 * a * self.d)
                raw = f.read(8 * k * self.d)
                if len(raw) != 8 * k * self.d:
                    raise MatrixError(f"{self.path}: it ends inside row {a + len(raw) // max(1, 8 * self.d)}")
                yield to_batch(a, np.frombuffer(raw, "<f8").reshape(k, self.d)[:, : self.dims])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeline_matrix"

    def schema(self):
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)


def headers(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, n, d) of the matrix files of a path, a folder or a pattern, by name. Only headers are read."""
    found, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    fs, out = found.getFileSystem(conf), []
    files = [x for s in fs.globStatus(found) or [] for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    for s in sorted((s for s in files if s.getPath().getName()[0] not in "_."), key=lambda s: s.getPath().toString()):
        name, size = s.getPath().toString(), s.getLen()
        n = d = -1
        if size >= HEADER_SIZE:
            stream = fs.open(s.getPath())
            n, d = struct.unpack(HEADER, struct.pack(">ii", stream.readInt(), stream.readInt()))
            stream.close()
        if n < 0 or d < 0 or size != HEADER_SIZE + 8 * n * d:
            raise MatrixError(f"{name}: not a whole matrix")
        out.append((name, n, d))
    if not out:
        raise MatrixError(f"{path}: no such matrix")
    return out


def record_words(n: int, d: int) -> int:
    """The most words, up to MOST_WORDS, of which a whole number makes up the file, header included."""
    return max(k for k in range(1, MOST_WORDS + 1) if (1 + n * d) % k == 0)


def read_matrix(spark: SparkSession, path: str, rows: int | None = None, dims: int | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """points(id, coords) of matrix files by any path that Hadoop reads; ids go on from file to file.

    Tasks read ranges of some ``split_bytes``. A row that two ranges share is put together from its ends. The points are
    written to the shared folder once, which all later passes read.
    """
    found, tables, first = headers(spark, path), [], 0
    n, d = sum(k for _, k, _ in found), {w for _, k, w in found if k}
    keep = n if rows is None else rows
    if len(d) > 1 or not 0 <= keep <= n or dims is not None and not 0 <= dims <= max(d, default=found[0][2]):
        raise MatrixError(f"{path}: {keep} x {dims} asked of matrices {[x[1:] for x in found]}")
    for name, k, wide in found:
        if 0 < k and first < keep and wide:
            tables.append(_ranges(spark, name, k, wide, first, split_bytes))
        first += k
    if not tables:
        return spark.createDataFrame([(k, []) for k in range(keep)] if not d or 0 in d else [], POINTS)
    pieces = tables[0]
    for t in tables[1:]:
        pieces = pieces.unionByName(t)
    pieces = written(pieces, "matrix")
    ends = F.array_sort(F.collect_list(F.struct("place", "coords")))
    torn = pieces.where("place IS NOT NULL").groupBy("id").agg(F.flatten(F.transform(ends, lambda e: e["coords"])).alias("coords"))
    return prefix(pieces.where("place IS NULL").select("id", "coords").unionByName(torn), None if keep == n else keep, dims)


def _ranges(spark: SparkSession, name: str, n: int, d: int, first: int, split_bytes: int) -> DataFrame:
    """(id, coords, place) of one file: whole rows, and with their place in the row the ends of those that ranges share."""
    words = record_words(n, d)
    conf = {"fixedlengthinputformat.record.length": str(8 * words), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)}
    lib = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(name, lib, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def chunks(parts: Iterator[tuple[int, bytearray]]) -> Iterator[tuple[int, bytes]]:
        """Neighbouring records as one, each with the word that it begins at; it ends where a row does, if it can."""
        at, held = None, bytearray()
        for place, raw in parts:
            if at is None:
                at = place // 8
            held += raw
            if len(held) >= CHUNK + 8 * d:
                stop = (at + len(held) // 8 - 1) // d * d + 1  # the last word before which whole rows end
                yield at, bytes(held[: 8 * (stop - at)])
                at, held = stop, held[8 * (stop - at) :]
        if held:
            yield at, bytes(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, raw in zip(part.column("word").to_pylist(), part.column("raw"), strict=True):
                x, w = np.frombuffer(raw.as_buffer(), "<f8"), at - 1
                if at == 0:
                    x, w = x[1:], 0
                low, high = min(-(-w // d) * d, w + len(x)), max((w + len(x)) // d * d, w)
                ends = [(w, min(low, w + len(x))), (max(high, low), w + len(x))] if low <= high else [(w, w + len(x))]
                if low < high:
                    whole = to_batch(first + low // d, x[low - w : high - w].reshape(-1, d))
                    for k in range(0, len(whole), BATCH):
                        some = whole.slice(k, BATCH)
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.nulls(len(some), pa.int32())], schema=PIECES)
                torn = [(first + a // d, x[a - w : b - w].tolist(), a % d) for a, b in ends if a < b]
                if torn:
                    yield pa.RecordBatch.from_pylist([dict(zip(PIECES.names, t, strict=True)) for t in torn], schema=PIECES)

    return spark.createDataFrame(records.mapPartitions(chunks), "word long, raw binary").mapInArrow(run, "id long, coords array<double>, place int")


def prefix(points: DataFrame, rows: int | None = None, dims: int | None = None) -> DataFrame:
    """Points of ids under ``rows``, with the first ``dims`` coordinates."""
    from treeline.functions.geometry import prefix as first

    out = points if rows is None else points.where(F.col("id") < rows)
    return out if dims is None else out.withColumn("coords", first(F.col("coords"), dims))
