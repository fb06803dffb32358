"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def thinned(rows: int, of: int, *by: str | Column) -> Column:
    """Whether a row is in a stretch of a hash's range that holds about twice the rows wanted.

    What ``orderBy(...).limit(rows)`` then brings to the driver is bounded, however many partitions there are.
    """
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(min(1.0, (2 * rows + 100) / max(of, 1)) * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_chars: int, of: int) -> list[tuple[int, object, str]]:
    """At most ``rows`` of (doc_id, label, whole text), in the order of a hash of the id.

    docs(doc_id, text), labels(doc_id, label) with one row per id, made from ``of`` rows at most. The hash is first cut
    where some four times the rows wanted should lie below; only if too few do, all labels are gone through. Texts over
    ``most_chars`` are passed over. So what comes to the driver is bounded in rows and in bytes.
    """
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col(label)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    share = (4 * rows + 100) / max(of, 1)
    low = known.where(F.xxhash64("doc_id") < F.lit(int(share * (1 << 64)) - (1 << 63))) if share < 1 else known
    spark = docs.sparkSession
    first = lambda df: [(int(r[0]), r[1]) for r in df.orderBy(*order).limit(rows).collect()]
    picked = first(low)
    if share < 1 and len(picked) < rows:
        picked = first(known)
    if not picked:
        return []
    kind = labels.schema[label].dataType.simpleString()
    wanted = spark.createDataFrame(picked, f"doc_id long, {label} {kind}")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    got = found.join(F.broadcast(wanted), "doc_id").orderBy(*order, F.md5("text")).limit(rows).select("doc_id", label, "text").collect()
    return [tuple(r) for r in got]
