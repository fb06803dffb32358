"""Splits of the points, subgraphs of the complete graph and the schedule of merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def n_subgraphs(splits: int) -> int:
    return splits * (splits + 1) // 2


def split_of(index: Column, n: int, splits: int) -> Column:
    """Contiguous split of the index-th of n points: split k holds k * n div s up to, not including, (k + 1) * n div s."""
    return F.expr("0").cast("int") if n == 0 else F.floor(((index + 1) * splits - 1) / F.lit(n)).cast("int")


MOST_RANGES = 128
DRAWN = 64  # keys drawn for each range


def range_of(rows: DataFrame, *order: str) -> Column:
    """The number of the range of keys that a row lies in, as an expression: bounds are drawn once, by a hash of the keys."""
    ranges = min(MOST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = [rows.schema[c].dataType for c in order]
    drawn = rows.select(*order).orderBy(F.xxhash64(*order)).limit(DRAWN * ranges).orderBy(*order).collect()
    bounds = drawn[:: max(1, -(-len(drawn) // ranges))][1:]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    at = lambda r: F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(r, kinds, strict=True))])

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < at(bounds[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(bounds))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows + index, dense from 0 in the given order: ranks within ranges plus the sizes of the ranges before.

    rows are read three times (bounds, sizes, ranks) and not written, so they should be a table; no sort is in one task.
    """
    placed = rows.withColumn("part", range_of(rows, *order))
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))  # a row a range
    offsets = counts.withColumn("offset", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "offset")
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("rank", rank).join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("offset") + F.col("rank")).alias("index"))


def indexed(points: DataFrame) -> DataFrame:
    """points + index, dense from 0 by id."""
    return numbered(points.select("id", "coords"), "id")


def with_splits(points: DataFrame, splits: int, n: int | None = None) -> DataFrame:
    """points + split, by the order of ids."""
    n = points.count() if n is None else n
    return indexed(points).withColumn("split", split_of(F.col("index"), n, splits)).select("id", "coords", "split")


def right_of(sg: Column) -> Column:
    """The larger split of a bipartite subgraph: its triangular root."""
    return F.floor((F.floor(F.sqrt(sg.cast("long") * 8 + 1)) + 1) / 2).cast("int")


def left_of(sg: Column, right: Column) -> Column:
    return (sg - right * (right - 1) / 2).cast("int")


def subgraphs(spark: SparkSession, splits: int) -> DataFrame:
    """(sg, l, r, kind): bipartite ones between splits l < r first, then the complete one of each split."""
    pairs = splits * (splits - 1) // 2
    sg = F.col("sg")
    r = F.when(sg < pairs, right_of(sg)).otherwise(sg - pairs).cast("int")
    left = F.when(sg < pairs, left_of(sg, r)).otherwise(r).cast("int")
    return spark.range(n_subgraphs(splits)).select(F.col("id").cast("int").alias("sg")).select("sg", left.alias("l"), r.alias("r"), F.when(sg < pairs, "bipartite").otherwise("complete").alias("kind"))


def members(points: DataFrame, splits: int) -> DataFrame:
    """points(id, coords, split) -> (sg, side, id, coords): each point once for each subgraph that its split is in.

    The table of subgraphs has splits * (splits + 1) / 2 rows whatever the points are, so it is the side to broadcast.
    """
    plan = subgraphs(points.sparkSession, splits).select("sg", "l", "r", F.explode(F.array_distinct(F.array("l", "r"))).alias("split"))
    return points.join(F.broadcast(plan), "split").select("sg", F.when(F.col("l") == F.col("r"), 0).when(F.col("split") == F.col("l"), 1).otherwise(2).alias("side"), "id", "coords")


def schedule(splits: int, fanin: int) -> list[int]:
    """Trees left after each round of merges, from all subgraphs down to 1."""
    out = [n_subgraphs(splits)]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanin))
    return out
