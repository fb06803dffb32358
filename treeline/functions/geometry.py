"""Distances and other scalar functions of points and edges, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance: squares of direct differences, summed from left to right."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def point_distance(id_a: Column, a: Column, id_b: Column, b: Column) -> Column:
    """0 between points of one id, else the distance of the coordinates."""
    return F.when(id_a == id_b, F.lit(0.0)).otherwise(distance(a, b))


def dimension(coords: Column) -> Column:
    return F.size(coords)


def prefix(coords: Column, d: int) -> Column:
    """The first d coordinates; an error where there are fewer."""
    return F.when(F.size(coords) >= d, F.slice(coords, 1, d)).otherwise(F.raise_error(F.concat(F.lit(f"dimension {d} asked of "), F.size(coords).cast("string"))))


def point_equals(id_a: Column, a: Column, id_b: Column, b: Column) -> Column:
    """By value."""
    return (id_a == id_b) & a.eqNullSafe(b)


def point_hash(id_: Column, coords: Column) -> Column:
    """id * 163 + d * 57 + truncated sum of coordinates, as a 32-bit integer."""
    total = F.aggregate(coords, F.lit(0.0), lambda s, x: s + x)
    wide = id_.cast("long") * 163 + F.size(coords) * 57 + total.cast("long")
    return (F.pmod(wide + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def point_string(id_: Column, coords: Column) -> Column:
    """``id: [x, y]``, with two decimals."""
    return F.concat(id_.cast("string"), F.lit(": ["), F.concat_ws(", ", F.transform(coords, lambda x: F.format_string("%.2f", x))), F.lit("]"))


def plain_string(id_: Column, coords: Column) -> Column:
    """``id x y``, with two decimals."""
    return F.concat_ws(" ", F.array_prepend(F.transform(coords, lambda x: F.format_string("%.2f", x)), id_.cast("string")))


def edge_string(src: Column, dst: Column, weight: Column) -> Column:
    return F.format_string("[(%d %d) %.6f]", src, dst, weight)


def swap_bytes(x: Column) -> Column:
    """The 32-bit integer with its bytes reversed."""
    x = x.cast("int")
    low = lambda k: F.shiftright(x, k).bitwiseAND(255).cast("long")
    wide = low(0) * (1 << 24) + low(8) * (1 << 16) + low(16) * 256 + low(24)
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")
