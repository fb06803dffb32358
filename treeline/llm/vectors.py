"""Search for the best rows by inner product, cell by cell: what the operators on vectors have in common.

Rows lie in numbered cells. Cells of few rows are packed into shards, and shards of many rows fall into chunks by a hash, so
a group that meets its probes in one task has at most some ROWS rows and PROBES probes, whatever a cell holds. Probes say
which cells they want to see. Each group gives the best k of its rows for each probe, so no group of all rows is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.session import written

ROWS, PROBES = 8192, 4096
AT_ONCE = 256
FOUND = "probe long, row long, id long, score double"
PROBE = "probe long, own long, label int, lo double, hi double, floor double, v array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its components and its square length are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & (F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x) < float("inf"))


def of_one_size(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows(v) of the size that most vectors have, this size, their number). Of sizes equally frequent, the larger one."""
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return (rows.where(F.size("v") == top["d"]), top["d"], top["n"]) if top else (rows, 0, 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


@dataclass
class Index:
    """rows: row, id, label, v, cell, written; counts: rows of each cell; the shard of each cell and the chunks of each shard."""

    rows: DataFrame
    counts: np.ndarray
    shard_of: np.ndarray
    chunks: np.ndarray


def packed(rows: DataFrame, counts: np.ndarray) -> Index:
    """Shards of neighbouring cells, of at most ROWS rows unless one cell alone has more."""
    shard, held, first = np.zeros(len(counts), np.int64), 0, True
    now = 0
    for cell, n in enumerate(counts.tolist()):
        if not first and held + n > ROWS:
            now, held = now + 1, 0
        shard[cell], held, first = now, held + n, False
    sizes = np.bincount(shard, weights=counts, minlength=1)
    return Index(rows, counts, shard, np.maximum(1, np.ceil(sizes / ROWS)).astype(np.int64))


def asked(probes: DataFrame, index: Index, cells: Callable[[dict[str, np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """probes -> one row for each shard that a probe wants to see, with the cells there. ``cells``: of the probes of a batch."""
    shard_of = index.shard_of

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, len(whole), 1024):
                part = whole.slice(at, 1024)
                lists = cells({"v": matrix(part.column("v"))} | {c: part.column(c).fill_null(np.nan).to_numpy() for c in ("lo", "hi", "floor")})
                cell = np.concatenate([*lists, np.zeros(0, np.int64)])
                who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                by = np.lexsort((cell, shard_of[cell], who))
                who, cell = who[by], cell[by]
                shard = shard_of[cell]
                new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])])[: len(who)])
                rows = part.take(pa.array(who[new]))
                made = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)), pa.int32()), pa.array(cell, pa.int32()))
                yield rows.append_column("shard", pa.array(shard[new], pa.int32())).append_column("cells", made)

    return probes.mapInArrow(run, f"{PROBE}, shard int, cells array<int>")


def kernel(k: int, scale: float, labels: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k rows for each probe within its window (lo <= scale * score <= hi), of the same or of other labels, or of any.

    A matrix product finds who may be among them; their scores are then summed component by component, so that equal
    vectors have equal scores wherever they lie.
    """

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        none = pa.table({"probe": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not asks.num_rows:
            return none
        rows = rows.take(pa.array(np.argsort(rows.column("cell").to_numpy(), kind="stable")))
        cell, row, ids, label, e = (*(rows.column(c).to_numpy() for c in ("cell", "row", "id", "label")), matrix(rows.column("v")))
        own, own_label, lo, hi, q = (*(asks.column(c).to_numpy() for c in ("own", "label", "lo", "hi")), matrix(asks.column("v")))
        lists = asks.column("cells").combine_chunks()
        wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        by = np.argsort(wanted, kind="stable")
        wanted, who = wanted[by], who[by]
        room = 1e-9 * np.sqrt((q * q).sum(1) * (e * e).sum(1).max())  # what sums in another order may differ by, and more
        there, first = np.unique(cell, return_index=True)
        found = []
        for c, a, b in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
            start, stop = np.searchsorted(wanted, [c, c + 1])
            for at in range(start, stop, AT_ONCE):
                p = who[at : min(at + AT_ONCE, stop)]
                s = q[p] @ e[a:b].T
                ok = (scale * (s + room[p, None]) >= lo[p, None]) & (scale * (s - room[p, None]) <= hi[p, None]) & (own[p, None] != row[None, a:b])
                if labels != "any":
                    ok &= (own_label[p, None] == label[None, a:b]) == (labels == "same")
                if b - a > k and ok.sum(1).max(initial=0) > k:
                    s[~ok] = -np.inf
                    ok &= s >= (np.partition(s, b - a - k, axis=1)[:, b - a - k] - room[p])[:, None]
                i, j = np.nonzero(ok)
                found.append((p[i], j + a))
        if not found:
            return none
        p, r = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.zeros(len(p))
        for x in range(q.shape[1]):
            score += q[p, x] * e[r, x]
        ok = (scale * score >= lo[p]) & (scale * score <= hi[p])
        p, r, score = p[ok], r[ok], score[ok]
        by = np.lexsort((row[r], ids[r], -score, p))
        p, r, score = p[by], r[by], score[by]
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[: len(p)])
        top = np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p)))) < k
        p, r = p[top], r[top]
        return pa.table({"probe": asks.column("probe").to_numpy()[p], "row": row[r], "id": ids[r], "score": score[top]})

    return run


def scanned(index: Index, asks: DataFrame, k: int, scale: float, labels: str) -> DataFrame:
    """asks, written -> (probe, row, id, score): for each probe the best k of each group of rows that it meets."""
    spark = asks.sparkSession
    blocks = {r["shard"]: -(-r["n"] // PROBES) for r in asks.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    plan = [(cell, s, int(index.chunks[s]), blocks[s]) for cell, s in enumerate(index.shard_of.tolist()) if s in blocks and index.counts[cell]]
    cells = spark.createDataFrame(plan, "cell int, shard int, chunks int, blocks int")
    shards = spark.createDataFrame(sorted({x[1:] for x in plan}), "shard int, chunks int, blocks int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.rows.join(F.broadcast(cells), "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int")).withColumn("block", upto("blocks"))
    right = asks.join(F.broadcast(shards), "shard").withColumn("block", F.pmod(F.xxhash64("probe"), "blocks").cast("int")).withColumn("chunk", upto("chunks"))
    key = ("shard", "chunk", "block")
    left = left.select(*key, "cell", "row", "id", "label", "v").groupBy(*key)
    right = right.select(*key, "probe", "own", "label", "lo", "hi", "v", "cells").groupBy(*key)
    return left.cogroup(right).applyInArrow(kernel(k, scale, labels), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each probe, with their rank from 1: greatest score first, then least id."""
    rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, probes: DataFrame, k: int, visits: Callable[[bool], Callable], scale: float = 1.0, labels: str = "any") -> DataFrame:
    """probes(probe, own, label, lo, hi, v), written -> (probe, row, id, score, rank).

    ``visits(True)`` names the cells to see first. What they give is a floor under the scores that still count, and
    ``visits(False)`` names the other cells that can reach it.
    """
    probes = probes.withColumn("floor", F.lit(None).cast("double")).select("probe", "own", "label", "lo", "hi", "floor", "v")
    first = written(best(scanned(index, written(asked(probes, index, visits(True)), "asked"), k, scale, labels), k).drop("rank"), "found")
    floors = first.groupBy("probe").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    later = probes.join(floors, "probe", "left").withColumn("floor", F.col("least")).withColumn("lo", F.greatest("lo", F.col("floor") * scale)).drop("least")
    later = written(asked(later.select(*probes.columns), index, visits(False)), "asked")
    return best(first.unionByName(scanned(index, later, k, scale, labels)), k)
