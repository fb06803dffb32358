"""Forests of large subgraphs from their near pairs: one square for all bounds what is listed, and few points go on alone.

The bound comes from a sample's nearest points and changes the work, not the result. Every pair within it is listed, so the
forest of these is that of single linkage up to the bound; all other edges of a tree have an end outside of the largest set, in
a *remote* point. Those meet all points once more. Where they are more than ``REMOTE``, nothing is given, and trees come by cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from treeline.operators.contraction import labelled, partial, spanning_forest
from treeline.operators.kernels import distances, forest, greatest_reached, tree, within
from treeline.plans.splits import n_subgraphs, subgraphs
from treeline.session import release, written

NEAR_ROWS = 48 << 10  # points that a side of a cell has, or somewhat more
LINKED = 10, 16  # others of its subgraph that a point has within the bound, about: the fewest and the most
DRAWN = 128  # points that the bound comes from
REMOTE = 1024  # points outside of the largest set that a subgraph may have
PACK = 1 << 20  # bytes of coordinates that a row holds
AT_A_TIME = 64  # neighbouring cells whose forests become one
FOREST = "sg int, cell int, src long, dst long, weight double"


def _coords(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("coords")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def bound(points: DataFrame, n: int, splits: int, linked: int = LINKED[1], remote: int = REMOTE) -> float | None:
    """The distance within which half of some drawn points have ``linked`` others in a subgraph; None where too many have none.

    points(id, coords, ...), a table of n. The drawn points meet all; the driver holds these and the nearest of each in a partition.
    """
    drawn = points.select("id", "coords").orderBy(F.xxhash64("id"), "id").limit(DRAWN).toArrow()
    ids, rows, most = drawn.column("id").to_numpy(), _coords(drawn), linked * splits

    middle = rows.mean(0) if len(rows) else 0
    rows = rows - middle

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(ids), most), np.inf)
        for part in parts:
            x, other = _coords(part) - middle if len(part) else np.zeros((0, rows.shape[1])), part.column("id").to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):  # products do: any bound is a right one
                d = np.maximum((x * x).sum(1) - 2 * (rows @ x.T) + (rows * rows).sum(1)[:, None], 0)
            d[(ids[:, None] == other) | ~np.isfinite(d)] = np.inf
            d = np.hstack([held, d])
            held = np.sort(np.partition(d, most - 1, axis=1)[:, :most], axis=1)
        at, _ = np.nonzero(np.isfinite(held))
        yield from pa.table({"at": at, "w": np.sqrt(held[np.isfinite(held)])}).to_batches()

    found = points.select("id", "coords").mapInArrow(run, "at long, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    order = np.lexsort((w, at))
    near = [x for x in np.split(w[order], np.flatnonzero(np.diff(at[order])) + 1) if len(x) >= most]
    if len(near) < len(ids) or not len(ids):
        return None
    top = float(np.median([x[most - 1] for x in near]))
    alone = sum(x[splits - 1] > top for x in near)
    return top if np.isfinite(top) and top > 0 and alone * n / DRAWN <= max(2 * remote, n / DRAWN) else None


def _pack(table: pa.Table) -> pa.Table:
    """A part's points by some PACK bytes; in half the bits where these hold the coordinates exactly."""
    ids, x, part = table.column("id").to_numpy(), _coords(table), table.column("part")[0].as_py()
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    x = half if np.array_equal(half, x) else x
    step = max(1, PACK // max(1, x.itemsize * x.shape[1]))
    cuts = [slice(k, k + step) for k in range(0, len(ids), step)]
    rows = [(part, len(ids[c]), x.itemsize, ids[c].tobytes(), x[c].tobytes()) for c in cuts]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "n", "bytes", "ids", "coords"])


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = table.column("n").to_numpy(), table.column("bytes").to_pylist()
    bits = lambda name: [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(name)]
    ids = np.concatenate([x.view(np.int64) for x in bits("ids")])
    coords = np.concatenate([x.view(f"f{s}").reshape(k, -1).astype(np.float64) for x, s, k in zip(bits("coords"), size, n, strict=True)])
    return ids, coords, np.repeat(table.column("side").to_numpy(), n)


def links(points: DataFrame, splits: int, parts: int, top: float, kind: str | None = None) -> DataFrame:
    """points(id, coords, split) -> (sg, cell, src, dst, weight): of each cell all pairs within ``top``, or its tree where these are too many."""
    spark, total = points.sparkSession, splits * parts
    part = (F.col("split") * parts + F.pmod(F.xxhash64("id"), F.lit(parts))).cast("int")
    packed = points.select(part.alias("part"), "id", "coords").repartitionById(total, "part").groupBy("part").applyInArrow(_pack, "part int, n int, bytes int, ids binary, coords binary")
    cells = subgraphs(spark, total).select(F.col("sg").alias("cell"), F.col("l").alias("a"), F.col("r").alias("b"), F.floor(F.col("l") / parts).cast("int").alias("l"), F.floor(F.col("r") / parts).cast("int").alias("r"))
    cells = cells.join(F.broadcast(wanted(spark, splits, kind)), ["l", "r"])
    plan = cells.select("cell", "sg", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    side = F.when(F.col("a") == F.col("b"), 0).when(F.col("part") == F.col("a"), 1).otherwise(2).alias("side")
    n_cells = n_subgraphs(total)

    def solve(table: pa.Table) -> pa.Table:
        ids, coords, sides = _unpack(table)
        found = within(ids, coords, sides, top)
        src, dst, weight = tree(ids, coords, sides) if found is None else found
        number = lambda c: pa.array(np.full(len(src), table.column(c)[0].as_py()), pa.int32())
        return pa.table({"sg": number("sg"), "cell": number("cell"), "src": src, "dst": dst, "weight": weight})

    placed = packed.join(F.broadcast(plan), "part").select("sg", "cell", side, "n", "bytes", "ids", "coords")
    return placed.repartitionById(n_cells, "cell").groupBy("cell").applyInArrow(solve, FOREST)


def wanted(spark, splits: int, kind: str | None) -> DataFrame:
    """(sg, l, r) of all subgraphs, or of the complete or bipartite ones."""
    plan = subgraphs(spark, splits)
    return (plan.where(F.col("kind") == kind) if kind else plan).drop("kind")


def as_forest(table: pa.Table) -> pa.Table:
    kept = forest(*(table.column(c).to_numpy() for c in ("src", "dst", "weight")))
    return table.take(pa.array(kept)).select(["sg", "cell", "src", "dst", "weight"])


def of_subgraphs(trees: DataFrame, cells: int) -> DataFrame:
    """(sg, cell, src, dst, weight) -> the same with cell 0: the forest of each subgraph, AT_A_TIME cells at once."""
    left = cells if cells > 1 else 2
    while left > 1:
        left = -(-left // AT_A_TIME)
        trees = partial(trees.withColumn("cell", F.floor(F.col("cell") / AT_A_TIME).cast("int")), "sg", "cell")
        trees = trees.groupBy("sg", "cell").applyInArrow(as_forest, FOREST)
    return trees


def parts_for(points: DataFrame, n: int, splits: int, near_rows: int, kind: str | None) -> int:
    """Parts of a split: at most some ``near_rows`` points, and three cells a core where those keep an eighth of that."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // (splits * near_rows)))
    cells = lambda p: splits * n_subgraphs(p) if kind == "complete" else n_subgraphs(splits * p)
    while cells(parts) < 3 * cores and n > splits * (parts + 1) * near_rows // 8:
        parts += 1
    return parts


def near_forests(points: DataFrame, n: int, splits: int, task_rows: int, kind: str | None = None, near_rows: int = NEAR_ROWS, remote: int = REMOTE) -> DataFrame | None:
    """points(id, coords, split), a table of n -> (sg, src, dst, weight): the tree of each subgraph; None where the bound doesn't serve.

    A task finishes at most ``task_rows`` links. Where there are more, with one split they become a forest by contraction, and
    otherwise those of AT_A_TIME cells become one first.
    """
    linked = max(LINKED[0], min(LINKED[1], 8 * task_rows // max(1, 5 * n))) if splits == 1 else LINKED[1]
    top = bound(points, n, splits, linked, remote)
    if top is None:
        return None
    spark, parts = points.sparkSession, parts_for(points, n, splits, near_rows, kind)

    def joined(edges: DataFrame, cells: int) -> DataFrame:
        if max((r["count"] for r in edges.groupBy("sg").count().collect()), default=0) <= task_rows:
            return edges.groupBy("sg").applyInArrow(as_forest, FOREST).select("sg", "src", "dst", "weight")
        if splits > 1:
            return of_subgraphs(edges, cells).select("sg", "src", "dst", "weight")
        return spanning_forest(edges.select("src", "dst", "weight"), task_rows).select(F.lit(0).alias("sg"), "src", "dst", "weight")

    seen = Observation()
    near = written(links(points, splits, parts, top, kind), "links")
    found = joined(near, n_subgraphs(splits * parts))
    found = written(found.observe(seen, F.count_if(F.col("weight") <= top).alias("within")), "near")
    release(near)
    plan = wanted(spark, splits, kind).select("sg", "l", "r", F.explode(F.array_distinct(F.array("l", "r"))).alias("split"))
    sizes = {r.split: r["count"] for r in points.groupBy("split").count().collect()} if splits > 1 else {0: n}
    spans = {r.sg: (r.l, r.r) for r in wanted(spark, splits, kind).collect()}
    due = {sg: sum(sizes.get(s, 0) for s in {*lr}) - 1 if all(sizes.get(s, 0) for s in lr) else 0 for sg, lr in spans.items()}
    if seen.get["within"] == sum(due.values()):
        return found

    close, place = found.where(F.col("weight") <= top), points.select("id", "split").join(F.broadcast(plan), "split").select("sg", "id")
    if splits == 1 and n > task_rows:
        named = written(labelled(points, close.select(F.col("src").alias("u"), F.col("dst").alias("v")), task_rows), "named")
        first = named.groupBy("root").count().orderBy(F.desc("count"), "root").first().root
        away = named.where(F.col("root") != first).select(F.lit(0).alias("sg"), "id")
    else:
        ends = close.select("sg", F.explode(F.array("src", "dst")).alias("id"))
        away = place.join(ends, ["sg", "id"], "left_anti").unionByName(close.groupBy("sg").applyInArrow(_outside, "sg int, id long"))
    away = written(away, "remote")
    counts = {r.sg: r["count"] for r in away.groupBy("sg").count().collect()}
    if max(counts.values()) > remote:
        release(found, away)
        return None
    side = F.when(F.col("l") == F.col("r"), 0).when(F.col("split") == F.col("l"), 1).otherwise(2).alias("side")
    rows = written(points.join(F.broadcast(away), "id").join(F.broadcast(plan), ["sg", "split"]).select("sg", side, "id", "coords"), "remote")
    held = {}
    for batch in rows.toArrow().to_batches():
        sg, sides, ids, x = batch.column("sg").to_numpy(), batch.column("side").to_numpy(), batch.column("id").to_numpy(), _coords(batch)
        for k in range(len(ids)):
            held.setdefault(int(sg[k]), []).append((int(sides[k]), int(ids[k]), x[k]))
    more = rows.groupBy("sg").applyInArrow(_among, FOREST).unionByName(points.mapInArrow(_to_the_rest(held, spans), FOREST))
    more = written(found.select("sg", F.lit(0).alias("cell"), "src", "dst", "weight").unionByName(more), "links")
    out = written(joined(more, 1), "near")
    release(found, away, rows, more)
    return out


def _outside(table: pa.Table) -> pa.Table:
    """The vertices of a subgraph's edges that are outside of their largest set."""
    vertices, root = greatest_reached(table.column("src").to_numpy(), table.column("dst").to_numpy())
    names, number, size = np.unique(root, return_inverse=True, return_counts=True)
    ids = vertices[number != size.argmax()]
    return pa.table({"sg": pa.array(np.full(len(ids), table.column("sg")[0].as_py()), pa.int32()), "id": ids})


def _among(table: pa.Table) -> pa.Table:
    """The tree of a subgraph's remote points."""
    src, dst, weight = tree(table.column("id").to_numpy(), _coords(table), table.column("side").to_numpy())
    return pa.table({"sg": pa.array(np.full(len(src), table.column("sg")[0].as_py()), pa.int32()), "cell": pa.array(np.zeros(len(src)), pa.int32()), "src": src, "dst": dst, "weight": weight})


def _to_the_rest(held: dict[int, list[tuple[int, int, np.ndarray]]], spans: dict[int, tuple[int, int]]):
    """Of each remote point, held by subgraph, the nearest of a batch that it has an edge to and that isn't remote, the least id of several."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, coords, split, out = part.column("id").to_numpy(), _coords(part), part.column("split").to_numpy(), []
            for sg, rows in held.items():
                left, right = spans[sg]
                inside = ~np.isin(ids, [i for _, i, _ in rows])
                to = {s: np.flatnonzero(inside & (split == t)) for s, t in ((0, left), (1, right), (2, left))}
                for s, i, x in rows:
                    if len(to[s]):
                        w = distances(x, coords[to[s]])
                        low = to[s][w == w.min()]
                        j = int(ids[low].min())
                        out.append((sg, 0, min(i, j), max(i, j), float(w.min())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["sg", "cell", "src", "dst", "weight"])

    return run
