"""All pairs of points, subgraph by subgraph, in blocks of the product.

Points are packed to blocks of a split and written once. Then two blocks meet in each task, which reads them where they are
written and hands their pairs on some AT_ONCE at a time. So neither what a task holds nor how long it takes grows with the
points, and scratch has each point once, not once for each block it meets; only the number of tasks grows with the points' square.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from treeline.session import written

PAIR = {"sg": "int", "src": "long", "dst": "long", "weight": "double"}
BLOCK_ROWS = 1 << 12  # points that a block has at most
BLOCK_BYTES = 1 << 22  # bytes of coordinates that a block has, or one point more
PACKED_AT_ONCE = 8  # blocks that a task packs, about: of each split the last may be a small one
AT_ONCE = 1 << 16  # pairs that are computed together
FILES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def _weights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all to all: squares of direct differences, summed from left to right. a, b: a row a coordinate."""
    total, d = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=True):
        np.subtract(x[:, None], y[None], out=d)
        d *= d
        total += d
    return np.sqrt(total, out=total)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` makes of x, of the decimal digits that a double is shown with; those are read only near a tie.

    A whole number over a power of ten up to 22 is the double nearest to that decimal, and products are off by an ulp or two.
    """
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * scale
        out = np.rint(y)
        y -= out
        np.abs(y, out=y)
        near = np.flatnonzero(~((y < 0.5 - 2**-10) & (np.abs(out) < 2**40)))
        out /= scale
    near = near[~((y.ravel()[near] < 0.5 - np.abs(out.ravel()[near]) * scale * 2**-50 - 2**-50) & (np.abs(out.ravel()[near]) * scale < 2**40))]
    to, exact = Decimal(1).scaleb(-digits), Context(prec=800, rounding=ROUND_HALF_UP)
    for k in near.tolist():
        v = float(x.flat[k])
        out.flat[k] = float(Decimal(repr(v)).quantize(to, context=exact)) if np.isfinite(v) else v
    return out


def _met(sg: int, one: pa.Table, other: pa.Table | None, digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks that have different ids, or of one block with itself. Weights as ``distance`` has them, rounded if
    ``digits`` are given: null where coordinates are missing or their numbers differ."""
    sides = np.zeros(len(one), np.int8) if other is None else np.repeat(np.array([1, 2], np.int8), [len(one), len(other)])
    table = (one if other is None else pa.concat_tables([one, other])).append_column("side", pa.array(sides)).sort_by("id")
    ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
    lists = table.column("coords").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy().copy()
    if lists.flatten().null_count:
        sizes[[k for k, x in enumerate(lists.to_pylist()) if x is not None and None in x]] = -1
    sets = []  # (side, rows, a row a coordinate or None)
    for s in np.unique(side):
        for size in np.unique(sizes[side == s]):
            at = np.flatnonzero((side == s) & (sizes == size))
            flat = None if size < 0 else lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            sets.append((s, at, None if flat is None else np.ascontiguousarray(flat.reshape(len(at), size).T)))
    for k, (s, mine, x) in enumerate(sets):
        for t, other, y in sets[k:]:
            if s == t != 0:
                continue
            alike = x is not None and y is not None and len(x) == len(y)
            step = max(1, AT_ONCE // len(other))
            for first in range(0, len(mine), step):
                here = slice(first, first + step)
                there = slice(first if mine is other else 0, None)
                a, b = ids[mine[here], None], ids[other[there]][None]
                low, high = np.minimum(a, b), np.maximum(a, b)
                weight = _weights(x[:, here], y[:, there]) if alike else np.zeros(low.shape)
                weight = weight if digits is None else rounded(weight, digits)
                some = a < b if mine is other else a != b
                low, high, weight = (z.ravel() if some.all() else z[some] for z in (low, high, weight))
                sgs = pa.array(np.full(len(low), sg, np.int32))
                yield pa.RecordBatch.from_arrays([sgs, pa.array(low), pa.array(high), pa.array(weight) if alike else pa.nulls(len(low), pa.float64())], names=list(PAIR))


def _block(table: pa.Table) -> bytes:
    """Points as bytes; coordinates in half the bits where these hold them exactly."""
    lists = table.column("coords").combine_chunks()
    flat = lists.flatten()
    half = pc.cast(flat, pa.float32(), safe=False)
    bits = lambda x: x.fill_null(0.0).to_numpy(zero_copy_only=False).view(np.int64)
    if np.array_equal(bits(half.cast(pa.float64())), bits(flat)):
        table = table.set_column(1, "coords", pc.cast(lists, pa.list_(pa.float32()), safe=False))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _points(block: bytes) -> pa.Table:
    table = pa.ipc.open_stream(pa.py_buffer(block)).read_all()
    return table.set_column(1, "coords", table.column("coords").cast(pa.list_(pa.float64())))


def _pack(block_rows: int):
    """points(id, coords, split) -> (split, number, block): numbers are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number = {}, TaskContext.get().partitionId() << 32

        def made(split: int, rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([split], pa.int32()), pa.array([number]), pa.array([_block(rows)], pa.binary())], names=["split", "number", "block"])

        for batch in batches:
            split, rows = batch.column("split").to_numpy(), pa.Table.from_batches([batch.select(["id", "coords"])])
            for s in np.unique(split).tolist():
                mine = rows.take(pa.array(np.flatnonzero(split == s)))
                mine = pa.concat_tables([held.pop(s), mine]) if s in held else mine
                while len(mine):
                    ends = pc.fill_null(pc.list_value_length(mine.column("coords").slice(0, block_rows)), 0).to_numpy().cumsum() * 8
                    fit = min(block_rows, int(np.searchsorted(ends, BLOCK_BYTES)) + 1)
                    if fit > len(mine) or fit == len(mine) < block_rows and ends[-1] < BLOCK_BYTES:
                        break
                    yield made(s, mine.slice(0, fit))
                    mine = mine.slice(fit)
                if len(mine):
                    held[s] = mine.combine_chunks()
        for s, rows in held.items():
            yield made(s, rows)

    return run


class _Blocks:
    """The blocks of points(id, coords, split), a table of n: written, a file and so a partition each."""

    def __init__(self, points: DataFrame, splits: int, block_rows: int, n: int | None):
        n = points.count() if n is None else n
        packed = points.where("id IS NOT NULL").coalesce(max(1, n // (PACKED_AT_ONCE * block_rows))).mapInArrow(_pack(block_rows), "split int, number long, block binary")
        self.table = written(packed, "blocks", "1m", by="split", records=1)
        self.spark, self.splits, self.held = points.sparkSession, splits, {}

    def of(self, split: int) -> RDD:
        """(number, block) of a split."""
        if split not in self.held:
            before = {k: self.spark.conf.get(k) for k in FILES}
            try:
                for k in FILES:  # a file that is opened fills a partition
                    self.spark.conf.set(k, str(2 * BLOCK_BYTES))
                self.held[split] = self.table.where(F.col("split") == split).select("number", "block").rdd
            finally:
                for k, v in before.items():
                    self.spark.conf.set(k, v)
        return self.held[split]

    def across(self) -> list[RDD]:
        """(sg, block, block) of all cells of two splits."""
        spans = [(left, right) for right in range(self.splits) for left in range(right)]
        return [self.of(left).cartesian(self.of(right)).map(_cell(sg)) for sg, (left, right) in enumerate(spans)]

    def within(self) -> list[RDD]:
        """(sg, block, block) of all cells of one split; (sg, block, None) of a block with itself."""
        first = self.splits * (self.splits - 1) // 2
        return [self.of(s).cartesian(self.of(s)).filter(_in_order).map(_cell(first + s)) for s in range(self.splits)]

    def pairs(self, cells: list[RDD], digits: int | None, kept: tuple[str, ...] = tuple(PAIR)) -> DataFrame:
        context = self.spark.sparkContext
        made = self.spark.createDataFrame(context.union(cells) if cells else context.emptyRDD(), "sg int, one binary, other binary")
        return made.mapInArrow(_solve(digits, list(kept)), ", ".join(f"{c} {PAIR[c]}" for c in kept))


def _in_order(met: tuple[Row, Row]) -> bool:
    return met[0].number <= met[1].number


def _cell(sg: int):
    return lambda met: (sg, met[0].block, None if met[0].number == met[1].number else met[1].block)


def _solve(digits: int | None, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sg, one, other in zip(*(batch.column(c) for c in ("sg", "one", "other")), strict=True):
                for made in _met(sg.as_py(), _points(one.as_buffer()), _points(other.as_buffer()) if other.is_valid else None, digits):
                    yield made.select(kept)

    return run


def pairs_across(points: DataFrame, splits: int, block_rows: int = BLOCK_ROWS, n: int | None = None, digits: int | None = None) -> DataFrame:
    """points(id, coords, split) -> (sg, src, dst, weight) of the bipartite subgraphs: each pair of two splits."""
    blocks = _Blocks(points, splits, block_rows, n)
    return blocks.pairs(blocks.across(), digits)


def pairs_within(points: DataFrame, splits: int, block_rows: int = BLOCK_ROWS, n: int | None = None, digits: int | None = None) -> DataFrame:
    """points(id, coords, split) -> (sg, src, dst, weight) of the complete subgraphs: each pair inside of a split."""
    blocks = _Blocks(points, splits, block_rows, n)
    return blocks.pairs(blocks.within(), digits)


def pairs(points: DataFrame, splits: int, block_rows: int = BLOCK_ROWS, n: int | None = None, digits: int | None = None) -> DataFrame:
    """points(id, coords, split) -> (src, dst, weight): all pairs, once each."""
    blocks = _Blocks(points, splits, block_rows, n)
    return blocks.pairs(blocks.across() + blocks.within(), digits, ("src", "dst", "weight"))
