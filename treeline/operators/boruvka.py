"""Boruvka's algorithm on an explicit pair table, for cross-checks of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from treeline.operators.contraction import spanning_forest


def boruvka(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """vertices(id), pairs(src, dst, weight) -> (src, dst, weight), by joins and aggregates only."""
    return spanning_forest(pairs, 0)
