"""Schemas of points, edges and forests, and the checks on input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("coords", T.ArrayType(T.DoubleType(), False), False)])
EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("weight", T.DoubleType(), False)])
EDGE_DDL = "src long, dst long, weight double"


@dataclass(frozen=True)
class MstConfig:
    """splits: parts the points are cut into (splits * (splits + 1) / 2 subgraphs); fanin: trees merged at once."""

    splits: int = 2
    fanin: int = 3

    def __post_init__(self) -> None:
        if self.splits < 1:
            raise ValueError(f"splits must be at least 1, not {self.splits}")
        if self.fanin < 2:
            raise ValueError(f"fanin must be at least 2, not {self.fanin}")


class Counters:
    """What a run counts on its way, with no job of its own: the first action on a watched table fills it."""

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def watch(self, df: DataFrame, *metrics: Column) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *metrics)

    def read(self) -> dict[str, int]:
        """Sums by name; waits until an action has passed every watched table."""
        out: dict[str, int] = {}
        for o in self.seen:
            for k, v in o.get.items():
                out[k] = out.get(k, 0) + v
        return out


class InvalidPoints(ValueError):
    """Points that have no defined distances."""


def as_points(df: DataFrame, id_col: str | Column, *coords: str | Column) -> DataFrame:
    """points(id, coords) from one array column or from numeric columns."""
    named = [F.col(c) if isinstance(c, str) else c for c in coords]
    array = isinstance(df.select(named[0]).schema[0].dataType, T.ArrayType)
    vector = named[0].cast("array<double>") if array else F.array(*[c.cast("double") for c in named])
    return df.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("id"), vector.alias("coords"))


def validated(points: DataFrame) -> DataFrame:
    """points, or InvalidPoints: null ids or coordinates, NaN, infinities, unequal dimensions, repeated ids. One job, on sums."""
    finite = F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = points.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.min(F.size("coords")).alias("lo"),
        F.max(F.size("coords")).alias("hi"),
        F.count_if(F.col("id").isNull() | F.col("coords").isNull() | ~F.coalesce(finite, F.lit(False))).alias("bad"),
    ).first()
    if found["bad"]:
        raise InvalidPoints(f"{found['bad']} points have a null id, or null or non-finite coordinates")
    if found["n"] and found["lo"] != found["hi"]:
        raise InvalidPoints(f"dimensions differ: {found['lo']} to {found['hi']}")
    if found["ids"] != found["n"]:
        raise InvalidPoints(f"{found['n'] - found['ids']} ids occur again")
    return points
