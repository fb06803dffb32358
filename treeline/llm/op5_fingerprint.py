"""Context-triggered piecewise hashing: chunks end where a rolling hash says so, each chunk gives one character.

A rolling hash of the last seven bytes ends a chunk wherever its low k bits are zero; k, the block exponent, is the
smallest for which the whole text has at most 64 chunks. The fingerprint ``k:signature:signature`` holds the chunk
signatures for k and for k + 1, so texts whose lengths differ by up to a factor of four or so can be compared: likeness
is 1 minus the edit distance of two signatures of the same block size over the longer length, the best of the sizes that
both have, and 0 without one. Edit distances of a whole batch are computed together, bit-parallel over 64-bit words.

The next document comes from a range sort on doc_id. A sorted partition pairs its own neighbours; the pairs that
straddle two partitions are made from the first and last text of each partition, which the partition writes along.

Defined results for odd input: null text counts as empty, whose fingerprint is ``0::``, and two empty texts have
likeness 1; null ids come last; rows with one id are ordered by the MD5 of their text and each is a document; a table
of one row is its own next document; very long texts are hashed whole, some 30 bytes a byte of text in one task at a time; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import written

NAME = "op5_fingerprints"
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MOST = 64  # chunks of a text, and bits of a word
WINDOW = 7
ROLL = 0x01000193
CHUNK = 0x9E3779B97F4A7C15
UNCHUNK = pow(CHUNK, -1, 1 << 64)


class Powers:
    """Powers of CHUNK and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, CHUNK, np.uint64)]))
                self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, UNCHUNK, np.uint64)]))


POWERS = Powers()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a mixed hash of the last WINDOW bytes."""
    x = data.astype(np.uint32) + np.uint32(1)
    h, m = x.copy(), 1
    for k in range(1, min(WINDOW, len(x))):
        m = m * ROLL & 0xFFFFFFFF
        h[k:] += x[:-k] * np.uint32(m)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(text: str) -> tuple[int, bytes, bytes]:
    """(block exponent, signature at that size, signature at twice that size), as values of 0 to 63."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    n = len(data)
    if not n:
        return 0, b"", b""
    h = rolling(data)
    # Only places where all of the first bits agree can end chunks at larger sizes.
    k = max(0, int(np.log2(n / MOST))) if n > MOST else 0
    ends = lambda k: np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)
    chunks = lambda e: len(e) + (not len(e) or e[-1] != n - 1)
    at = ends(k)
    while chunks(at) > MOST:
        k += 1
        at = ends(k)
    while k and chunks(finer := ends(k - 1)) <= MOST:
        k, at = k - 1, finer
    POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[:n], out=total[1:])

    def signature(at: np.ndarray) -> bytes:
        stop = at + 1
        if not len(stop) or stop[-1] != n:
            stop = np.append(stop, n)
        start = np.concatenate([[0], stop[:-1]])
        value = (total[stop] - total[start]) * POWERS.down[start]
        value ^= value >> np.uint64(29)
        return (value * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(58)).astype(np.uint8).tobytes()

    return k, signature(at), signature(at[(h[at] & np.uint32((2 << k) - 1)) == 0])


def shown(f: tuple[int, bytes, bytes]) -> str:
    return f"{f[0]}:" + ":".join(SIGNS[np.frombuffer(s, np.uint8)].tobytes().decode() for s in f[1:])


def edit_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distance of each pair of strings of values 0 to 63, of at most 64 each: Myers' bit-parallel steps, all pairs at once."""
    rows = np.arange(len(a))
    la, lb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    grid = lambda y: np.frombuffer(b"".join(x.ljust(MOST, b"\x40") for x in y), np.uint8).reshape(-1, MOST)
    pattern, text = grid(a), grid(b)
    same = np.zeros((len(a), 65), np.uint64)
    for j in range(int(la.max(initial=0))):
        same[rows, pattern[:, j]] |= np.uint64(1 << j)
    same[:, 64] = 0
    top = np.maximum(la - 1, 0).astype(np.uint64)
    one = np.uint64(1)
    up, down, score = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(a), np.uint64), la.copy()
    for j in range(int(lb.max(initial=0))):
        eq = same[rows, text[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up), up & xh
        score += np.where(j < lb, (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64), 0)
        plus, minus = plus << one | one, minus << one
        up, down = minus | ~(xv | plus), plus & xv
    return np.where(la == 0, lb, score)


def likeness(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Of each pair of fingerprints, 0 to 1."""
    pairs = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x[0] == y[0]:
            pairs += [(i, x[1], y[1]), (i, x[2], y[2])]
        elif x[0] + 1 == y[0]:
            pairs.append((i, x[2], y[1]))
        elif y[0] + 1 == x[0]:
            pairs.append((i, x[1], y[2]))
    out = np.zeros(len(a))
    if pairs:
        at, s, t = zip(*pairs, strict=True)
        longer = np.array([max(len(x), len(y), 1) for x, y in zip(s, t, strict=True)])
        np.maximum.at(out, np.array(at), 1 - edit_distances(list(s), list(t)) / longer)
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
WRITTEN = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *FIELDS])


def paired(ids: list, texts: list[str], nexts: list[str]) -> dict[str, list]:
    """The result columns of documents and the documents that follow them."""
    cut = [len(x) // 3 for x in texts]
    edited = [x[: len(x) - c] + y[:c] for x, y, c in zip(texts, nexts, cut, strict=True)]
    f, e = [fingerprint(x) for x in texts], [fingerprint(x) for x in edited]
    chained = all(nexts[i] is texts[i + 1] for i in range(len(texts) - 1))
    g = [*f[1:], fingerprint(nexts[-1])] if chained and texts else [fingerprint(x) for x in nexts]
    return {
        "doc_id": ids, "n_chars": [len(x) for x in texts], "edited_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited],
        "fingerprint": [shown(x) for x in f], "edited_fingerprint": [shown(x) for x in e], "near_edited": likeness(f, e), "near_next": likeness(f, g),
    }


def neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its first (kind 1) and last (kind 2) document come with their texts."""
    at, held = TaskContext.get().partitionId(), None

    def row(kind: int, columns: dict[str, list]) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        full = {c: [None] * n for c in WRITTEN.names} | columns | {"kind": [kind] * n, "part": [at] * n}
        return pa.RecordBatch.from_pydict(full, schema=WRITTEN)

    for part in parts:
        ids, texts = part["doc_id"].to_pylist(), [x or "" for x in part["text"].to_pylist()]
        for start in range(0, len(ids), 512):
            i, t = ids[start : start + 512], texts[start : start + 512]
            if held is None:
                yield row(1, {"doc_id": [i[0]], "text": [t[0]]})
            else:
                i, t = [held[0], *i], [held[1], *t]
            held = i[-1], t[-1]
            if len(i) > 1:
                yield row(0, paired(i[:-1], t[:-1], t[1:]))
    if held is not None:
        yield row(2, {"doc_id": [held[0]], "text": [held[1]]})


def straddling(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        if len(part):
            yield pa.RecordBatch.from_pydict(paired(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["next_text"].to_pylist()), schema=FIELDS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> RESULT, one row per document."""
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.md5(F.coalesce("text", F.lit(""))).asc()]
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(ordered.mapInArrow(neighbours, f"kind int, part int, text string, {RESULT}"), "fingerprints")
    first = made.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    parts = sorted(r[0] for r in made.where("kind = 1").select("part").collect())  # one number a partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    last = made.where("kind = 2").join(F.broadcast(follows), "part").join(first, "next_part").select("doc_id", "text", "next_text")
    return made.where("kind = 0").select(*FIELDS.names).unionByName(last.mapInArrow(straddling, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``query`` that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(t)))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 3) || left(u, n // 3)) AS edited_sha256 FROM n
"""
