"""The exact spanning tree of points in few dimensions: blocks of a kd-tree, and only the pairs of blocks that can hold an edge.

1. Equal points hang on the least of their ids, by the order of edges, and only that one goes on.
2. A kd-tree over a sample of FIT_ROWS points deals the points to at most MOST_BLOCKS blocks. Each gives its tree, and for
   each point its *height*: the greatest weight on its way along that tree to the block's core, the point nearest its middle.
3. A tree over one point a block joins the blocks. For each two that it joins, the pair of points of least distance and
   heights is found exactly, so the ways between the cores of any two blocks have a known greatest weight.
4. An edge between two points of two blocks that is longer than both their heights and the way between the cores closes a
   cycle of shorter ones. So points that lie further than this from the boxes of the other block's points (in three
   classes, by height) are left out, and pairs of blocks without any point left. The rest give the forest of their edges.
5. The trees and forests together become one by contraction.

The tables by block that the driver holds and broadcasts have MOST_BLOCKS rows, or pairs of these. In many dimensions no pair
is left out, and ``mst`` does the same work with fewer jobs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.model import Counters, validated
from treeline.operators.contraction import FOREST, TASK_ROWS, spanning_forest
from treeline.operators.kernels import forest, prim
from treeline.session import written

FIT_ROWS = 1 << 15
BLOCK_ROWS = 512
MOST_BLOCKS = 2048
AT_ONCE = 1 << 20  # distances
DRAWN = 128  # points of a block that give a first bound of its distance from others
FOUND = FOREST + ", distances long"
CLASSES = (0.8, 0.97)  # shares of the points of a block, by height, that end a class


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def kd_tree(sample: np.ndarray, leaves: int) -> np.ndarray:
    """Nodes (dimension, threshold, child not above it, child above it); a child under 0 is leaf -1 - child.

    The largest part is divided next, where its middle half has the widest gap in any dimension: so blocks tend to end where
    clusters do.
    """
    nodes: list[list[float]] = []
    parts, todo = [(np.arange(len(sample)), -1, 0)], [(-len(sample), 0)]  # rows, parent, side
    done: list[int] = []
    while todo and len(todo) + len(done) < leaves:
        size, part = heapq.heappop(todo)
        own, parent, side = parts[part]
        x = np.sort(sample[own], axis=0)
        low, high = -size // 4, max(-size // 4 + 1, -(3 * size // 4))
        gap = np.diff(x[low : high + 1], axis=0) if -size > 1 else np.zeros((0, 1))
        if not gap.size or not gap.max() > 0:  # equal in every dimension, as far as the middle half goes
            gap, low = np.diff(x, axis=0), 0
            if not gap.size or not gap.max() > 0:
                done.append(part)
                continue
        row, dim = np.unravel_index(gap.argmax(), gap.shape)
        at = (x[low + row, dim] + x[low + row + 1, dim]) / 2
        below = sample[own, dim] <= at
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        for k, rows in enumerate((own[below], own[~below])):
            heapq.heappush(todo, (-len(rows), len(parts)))
            parts.append((rows, len(nodes), k))
        nodes.append([dim, at, 0, 0])
    for leaf, part in enumerate(sorted([*done, *(p for _, p in todo)])):
        _, parent, side = parts[part]
        if parent >= 0:
            nodes[parent][2 + side] = -1 - leaf
    return np.array(nodes).reshape(-1, 4)


def block_of(coords: np.ndarray, tree: np.ndarray) -> np.ndarray:
    node = np.zeros(len(coords), np.int64) if len(tree) else np.full(len(coords), -1)
    while (live := np.flatnonzero(node >= 0)).size:
        at = tree[node[live]]
        above = coords[live, at[:, 0].astype(np.int64)] > at[:, 1]
        node[live] = np.where(above, at[:, 3], at[:, 2]).astype(np.int64)
    return -1 - node


def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, summed as ``kernels.distances`` does."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        total += d * d
    return np.sqrt(total)


def to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of rows of x to boxes, row by row or broadcast."""
    gap = np.maximum(np.maximum(low - x, x - high), 0)
    return np.sqrt((gap * gap).sum(-1))


def bottlenecks(blocks: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """For each two blocks the greatest weight on the way between them along a tree."""
    out, sets = np.zeros((blocks, blocks)), {k: np.array([k]) for k in range(blocks)}
    name = np.arange(blocks)
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        one, two = sets.pop(int(name[a])), sets.pop(int(name[b]))
        out[np.ix_(one, two)] = w
        out[np.ix_(two, one)] = w
        both = np.concatenate([one, two])
        name[both] = both[0]
        sets[int(both[0])] = both
    return out


def heights(root: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The greatest weight on the way from each vertex of a tree to the root. Vertices are 0 .. len(a)."""
    beside: list[list[tuple[int, float]]] = [[] for _ in range(len(a) + 1)]
    for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
        beside[x].append((y, w))
        beside[y].append((x, w))
    out, todo = [-1.0] * len(beside), [root]
    out[root] = 0.0
    while todo:
        x = todo.pop()
        for y, w in beside[x]:
            if out[y] < 0:
                out[y] = max(out[x], w)
                todo.append(y)
    return np.array(out)


def _tree(table: pa.Table) -> pa.Table:
    """Of a block its edges, and its points with height and class; the first row counts distances."""
    ids, coords = table.column("id").to_numpy(), matrix(table.column("coords"))
    m = len(ids)
    src, dst, weight = prim(ids, coords, np.zeros(m, np.int64))
    order = np.argsort(ids)
    place = lambda x: order[np.searchsorted(ids, x, sorter=order)]
    high = heights(int(((coords - np.median(coords, axis=0)) ** 2).sum(1).argmin()), place(src), place(dst), weight)
    seen = np.zeros(m, np.int64)
    seen[0] = m * (m - 1) // 2
    block = np.full(m, table.column("block")[0].as_py(), np.int32)
    points = pa.table({"block": block, "src": pa.array(ids), "dst": pa.nulls(m, pa.int64()), "weight": high, "distances": seen, "cls": np.searchsorted(np.quantile(high, CLASSES), high).astype(np.int32), "coords": table.column("coords")})
    edges = pa.table({"block": block[1:], "src": src, "dst": dst, "weight": weight, "distances": seen[1:], "cls": pa.nulls(m - 1, pa.int32()), "coords": pa.nulls(m - 1, points.schema.field("coords").type)})
    return pa.concat_tables([points, edges])


class Side:
    """Points of one block in a pair: ids, coordinates, heights."""

    def __init__(self, ids: np.ndarray, coords: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.coords, self.high = ids, coords, high

    def of(self, which: np.ndarray) -> Side:
        return Side(self.ids[which], self.coords[which], self.high[which])

    def near(self, other: Side, way: float) -> Side:
        """Without the points that are too far from the box of the others, whatever these are."""
        if not len(self.ids) or not len(other.ids):
            return self.of(np.zeros(0, np.int64))
        most = np.maximum(np.maximum(self.high, other.high.max()), way) * (1 + 1e-9)
        return self.of(to_boxes(self.coords, other.coords.min(0), other.coords.max(0)) <= most)


def _met(table: pa.Table) -> Iterator[tuple[Side, Side, float]]:
    """Class by class, the points of the two sides that are near each other."""
    way, right, cls = table.column("way")[0].as_py(), table.column("right").to_numpy(zero_copy_only=False), table.column("cls").to_numpy()
    whole = Side(table.column("id").to_numpy(), matrix(table.column("coords")), table.column("high").to_numpy())
    for one in range(len(CLASSES) + 1):
        for two in range(len(CLASSES) + 1):
            x, y = whole.of(~right & (cls == one)), whole.of(right & (cls == two))
            size = -1
            while size != len(x.ids) + len(y.ids):
                size = len(x.ids) + len(y.ids)
                x = x.near(y, way)
                y = y.near(x, way)
            if size:
                yield x, y, way


def _closest(table: pa.Table) -> pa.Table:
    """The least of the greatest of distance and both heights."""
    least, seen = np.inf, 0
    for x, y, _ in _met(table):
        step = max(1, AT_ONCE // len(y.ids))
        seen += len(x.ids) * len(y.ids)
        for k in range(0, len(x.ids), step):
            d = crossing(x.coords[k : k + step], y.coords)
            least = min(least, float(np.maximum(np.maximum(d, x.high[k : k + step, None]), y.high[None]).min()))
    return pa.table({"pair": pa.array([table.column("pair")[0].as_py()], pa.int64()), "least": [least], "distances": pa.array([seen], pa.int64())})


def _cross(table: pa.Table) -> pa.Table:
    """The forest of the edges between both sides that may count, and a row without an edge that counts distances."""
    src, dst, weight, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    for x, y, way in _met(table):
        step = max(1, AT_ONCE // len(y.ids))
        seen += len(x.ids) * len(y.ids)
        for k in range(0, len(x.ids), step):
            d = crossing(x.coords[k : k + step], y.coords)
            p, q = np.nonzero(d <= np.maximum(np.maximum(x.high[k : k + step, None], y.high[None]), way) * (1 + 1e-9))
            a, b = x.ids[k + p], y.ids[q]
            src, dst, weight = np.concatenate([src, np.minimum(a, b)]), np.concatenate([dst, np.maximum(a, b)]), np.concatenate([weight, d[p, q]])
            if len(src) > AT_ONCE:
                kept = forest(src, dst, weight)
                src, dst, weight = src[kept], dst[kept], weight[kept]
    kept = forest(src, dst, weight)
    more = lambda a, t: pa.array([*a[kept].tolist(), None], t)
    return pa.table({"src": more(src, pa.int64()), "dst": more(dst, pa.int64()), "weight": more(weight, pa.float64()), "distances": pa.array([0] * len(kept) + [seen], pa.int64())})


MET = "pair long, right boolean, way double, id long, high double, cls int, coords array<double>"


def paired(points: DataFrame, pairs: np.ndarray, way: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> DataFrame:
    """points(block, id, high, cls, coords), pairs of blocks -> MET: the points of each pair that are near the other block.

    low, high, top: boxes and greatest heights of blocks and classes; a class without a point has a box beyond reach.
    """
    both = np.concatenate([pairs, pairs[:, ::-1]])
    by = np.argsort(both[:, 0], kind="stable")
    shared = points.sparkSession.sparkContext.broadcast((both[by, 0], both[by, 1], by % max(1, len(pairs)), by >= len(pairs), way, low, high, top))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, pair, right, way, low, high, top = shared.value
        for part in filter(len, parts):
            block, coords, mine = part.column("block").to_numpy(), matrix(part.column("coords")), part.column("high").to_numpy()
            rows, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in np.unique(block).tolist():
                at = np.flatnonzero(block == b)
                for k in range(*np.searchsorted(own, [b, b + 1])):
                    o = other[k]
                    most = np.maximum(np.maximum(mine[at][:, None], top[o][None]), way[pair[k]]) * (1 + 1e-9)
                    near = at[(to_boxes(coords[at][:, None], low[o][None], high[o][None]) <= most).any(1)]
                    rows.append(near)
                    slots.append(np.full(len(near), k))
            row, slot = np.concatenate(rows), np.concatenate(slots)
            for k in range(0, len(row), 10_000):
                r, s = pa.array(row[k : k + 10_000]), slot[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(pair[s], pa.int64()), pa.array(right[s]), pa.array(way[pair[s]]), *(part.column(c).take(r) for c in ("id", "high", "cls", "coords"))], names=["pair", "right", "way", "id", "high", "cls", "coords"])

    return points.select("block", "id", "high", "cls", "coords").mapInArrow(run, MET)


def spatial_mst(points: DataFrame, check: bool = True, counters: Counters | None = None, block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """points(id, coords) -> (src, dst, weight): the edges that ``mst`` gives.

    A task holds one block of some ``block_rows`` points, or the parts of two that lie near each other.
    """
    points = validated(points) if check else points
    counters = counters or Counters()
    first = points.groupBy("coords").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    singles = written(first.select(F.col("least").alias("id"), "coords", "n"), "points")
    n, whole = singles.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = singles.where("n > 1").select(F.col("id").alias("src"), "coords") if n < whole else singles.select(F.col("id").alias("src"), "coords").limit(0)
    copies = points.join(several, "coords").where("id <> src").select("src", F.col("id").alias("dst"), F.lit(0.0).alias("weight"))
    singles = singles.drop("n")
    if n < 2:
        return copies
    sample = np.array([r["coords"] for r in singles.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("coords").collect()])
    tree = kd_tree(sample, min(MOST_BLOCKS, -(-n // block_rows), len(sample)))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in filter(len, parts):
            yield part.append_column("block", pa.array(block_of(matrix(part.column("coords")), tree), pa.int32()))

    width = range(sample.shape[1])
    blocks = singles.mapInArrow(place, "id long, coords array<double>, block int")
    solved = blocks.groupBy("block").applyInArrow(_tree, "block int, " + FOUND + ", cls int, coords array<double>")
    solved = written(counters.watch(solved, F.sum("distances").alias("distances"), F.count("dst").alias("edges_local")), "trees")
    edges = solved.where("dst IS NOT NULL").select("src", "dst", "weight")
    edges = edges.unionByName(copies) if n < whole else edges
    held = solved.where("dst IS NULL").select("block", F.col("src").alias("id"), F.col("weight").alias("high"), "cls", "coords")
    ends = [F.array(*[f(F.col("coords")[k]) for k in width]) for f in (F.min, F.max)]
    stats = held.groupBy("block", "cls").agg(*ends, F.max("high"), F.min(F.struct("high", "id", "coords"))["coords"]).orderBy("block", "cls").collect()  # a row a class
    number = {b: k for k, b in enumerate(sorted({r["block"] for r in stats}))}
    classes, d = len(CLASSES) + 1, sample.shape[1]
    low, high, top = np.full((len(number), classes, d), np.inf), np.full((len(number), classes, d), -np.inf), np.zeros((len(number), classes))
    core = np.zeros((len(number), d))
    for block, cls, *rest in reversed(stats):
        k = number[block]
        low[k, cls], high[k, cls], top[k, cls], core[k] = rest  # of the least class the core comes last
    if len(number) > 1:
        names = held.sparkSession.createDataFrame(list(number.items()), "block int, k int")
        held = held.join(F.broadcast(names), "block").drop("block").withColumnRenamed("k", "block")
        a, b, far = prim(np.arange(len(number)), core, np.zeros(len(number), np.int64))
        joined, leaf = np.stack([a, b], 1), block_of(sample, tree)
        some = [sample[np.flatnonzero(leaf == block)[:DRAWN]] for block in number]
        far = np.array([crossing(some[x], some[y]).min() if len(some[x]) and len(some[y]) else w for (x, y), w in zip(joined.tolist(), far, strict=True)])
        near = paired(held, joined, far, low, high, top).groupBy("pair").applyInArrow(_closest, "pair long, least double, distances long")
        least = {r["pair"]: r["least"] for r in counters.watch(near, F.sum("distances").alias("distances")).collect()}
        way = bottlenecks(len(number), [(int(x), int(y), least[k]) for k, (x, y) in enumerate(joined.tolist())])
        meet = []
        for k in range(len(number) - 1):
            other, met = np.arange(k + 1, len(number)), np.zeros(len(number) - k - 1, bool)
            for one in range(classes):
                for two in range(classes):
                    gap = np.maximum(np.maximum(low[k, one] - high[other, two], low[other, two] - high[k, one]), 0)
                    met |= np.sqrt((gap * gap).sum(1)) <= np.maximum(np.maximum(top[k, one], top[other, two]), way[k, other]) * (1 + 1e-9)
            meet.append(np.stack([np.full(met.sum(), k), other[met]], 1))
        pairs = np.concatenate(meet)
        crossed = paired(held, pairs, way[pairs[:, 0], pairs[:, 1]], low, high, top).groupBy("pair").applyInArrow(_cross, FOUND)
        crossed = counters.watch(crossed, F.sum("distances").alias("distances"), F.count("src").alias("edges_between"), F.count_if(F.col("src").isNull()).alias("pairs_met"))
        edges = edges.unionByName(crossed.where("src IS NOT NULL").select("src", "dst", "weight"))
    return spanning_forest(edges, task_rows)
