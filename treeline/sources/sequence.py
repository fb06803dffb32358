"""Points in Hadoop sequence files, through Hadoop's own formats: any file system, compressed or not, many tasks a file.

Keys are null; a value is a big-endian int32 id, an int32 length and that many float64. Written values are of the class
BytesWritable; read are these and, as raw bytes, those of any other class on the class path with this layout.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources.matrix import SCHEMA

LIB = "org.apache.hadoop.mapreduce.lib"
BYTES, NULL = "org.apache.hadoop.io.BytesWritable", "org.apache.hadoop.io.NullWritable"
AT_ONCE = 1000  # values that go to the workers together
MOST_ID = (1 << 31) - 1


class SequenceError(ValueError):
    """A value that is no point."""


def point(raw: bytes) -> tuple[int, np.ndarray]:
    """(id, coords) of a raw value. A BytesWritable begins with its length, so its size leaves 4 when divided by 8."""
    at = 4 if len(raw) % 8 == 4 else 0
    if len(raw) < at + 8:
        raise SequenceError(f"no point: {len(raw)} bytes")
    id_, d = struct.unpack_from(">ii", raw, at)
    if d < 0 or len(raw) != at + 8 + 8 * d:
        raise SequenceError(f"no point: {len(raw)} bytes for {d} coordinates")
    return id_, np.frombuffer(raw, ">f8", d, at + 8).astype(np.float64)


def read_points(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """points(id, coords) of the sequence files under a path. A damaged file fails the query."""
    conf = {"mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)}
    pairs = spark.sparkContext.newAPIHadoopFile(path, f"{LIB}.input.SequenceFileAsBinaryInputFormat", BYTES, BYTES, conf=conf)

    def together(parts: Iterator[tuple[bytearray, bytearray]]) -> Iterator[tuple[list[bytes]]]:
        held: list[bytes] = []
        for _, raw in parts:
            held.append(bytes(raw))
            if len(held) == AT_ONCE:
                yield (held,)
                held = []
        if held:
            yield (held,)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for values in part.column("values").to_pylist():
                ids, rows = zip(*map(point, values), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(rows), SCHEMA.field("coords").type)], schema=SCHEMA)

    return spark.createDataFrame(pairs.mapPartitions(together), "values array<binary>").mapInArrow(run, "id long, coords array<double>")


def write_points(points: DataFrame, path: str, compression: str = "none") -> None:
    """points(id, coords) to a new folder of sequence files, one a partition. compression: none, record or block.

    Ids must fit 32 bits, as the format has it.
    """
    wide = F.raise_error(F.concat(F.lit("an id too long for the format: "), F.col("id").cast("string")))
    fit = F.when(F.col("id").between(-MOST_ID - 1, MOST_ID), F.col("id")).otherwise(wide.cast("long"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("coords")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(">f8"), np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            made = [struct.pack(">ii", i, b - a) + flat[a:b].tobytes() for i, a, b in zip(part.column("id").to_pylist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    values = points.select(fit.alias("id"), "coords").mapInArrow(run, "value binary")
    conf = {"mapreduce.output.fileoutputformat.compress": str(compression != "none").lower(), "mapreduce.output.fileoutputformat.compress.type": compression.upper(), "mapreduce.output.fileoutputformat.compress.codec": "org.apache.hadoop.io.compress.DefaultCodec"}
    values.rdd.map(lambda r: (None, r[0])).saveAsNewAPIHadoopFile(path, f"{LIB}.output.SequenceFileOutputFormat", NULL, BYTES, conf=conf)
