"""Runs of words (stretches that repeat with a period) by longest previous factors, and texts with the repeats taken out.

A run is a stretch of words with smallest period q and at least ``least`` words and ``times`` periods that no word next to
it extends. The texts of a batch are put together in blocks, each followed by a mark of its own, which no run can span:

1. Prefix doubling sorts the suffixes of a block. Each round names the stretches of 1, 2, 4, .. words; the names stay and
   give the longest common prefix (or suffix) of any two places in a few look-ups.
2. A suffix's nearest neighbours in the suffix array that start before it give its longest previous factor, and the factor
   at each block's end starts the next block of the Lempel-Ziv parse.
3. A run that touches a boundary between two such blocks has a period below (length of both) / (times - 1). So for each
   boundary and each period up to that, common prefixes and suffixes around the boundary show whether there is a run.
4. A run inside of a block was there before: it is copied from the block's earlier occurrence, where the runs found so far
   lie in buckets by their start.

Work is n log n for n words, whatever the text; one text is held by one task, some 300 bytes a word.

Defined results for odd input: null, empty and wordless texts have no words and no runs, and collapse to the empty text;
repeated rows are documents of their own with equal results; of runs of one exponent the first counts as greatest; a null
doc_id has no checksum, so its words stay as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op11_runs"
LEAST, TIMES = 6, 4
BLOCK = 1 << 17  # words that are looked at together; a longer text is a block of its own
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, names) of symbols whose last occurs once: names[k, i] names the 2**k symbols from i on.

    Names of a stretch that occurs once only are told apart, not compared: each round sorts the other places alone.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    slots, key, place = np.arange(n), x[order], order
    rank, levels, h = np.empty(n, np.int64), [], 1
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        order[slots] = place
        rank[place] = np.maximum.accumulate(np.where(new, slots, 0))
        several = ~(new & np.append(new[1:], True))
        if not several.any():
            break
        levels.append(rank.astype(np.int32))
        slots, place = slots[several], place[several]
        key = rank[place] * n + rank[place + h]  # the first h symbols occur elsewhere, so they don't reach the last one
        by = np.argsort(key, kind="stable")
        key, place, h = key[by], place[by], 2 * h
    return order, np.stack(levels) if levels else np.zeros((0, n), np.int32)


def common(names: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from places i and j on are equal, i and j included; ``back``: towards the start. i and j differ."""
    total = np.zeros(len(i), np.int64)
    top = np.full(len(i), -1)
    live = np.arange(len(i))

    def same(k: int, at: np.ndarray) -> np.ndarray:
        a, b = (i[at] - total[at], j[at] - total[at]) if back else (i[at] + total[at], j[at] + total[at])
        if not back:
            return names[k][a] == names[k][b]
        low = np.minimum(a, b) >= (1 << k) - 1
        return low & (names[k][np.where(low, a - (1 << k) + 1, 0)] == names[k][np.where(low, b - (1 << k) + 1, 0)])

    for k in range(len(names)):
        live = live[same(k, live)]
        if not len(live):
            break
        top[live] = k
    live = np.flatnonzero(top >= 0)
    total[live] = np.left_shift(1, top[live])
    for k in range(int(top.max(initial=0)) - 1, -1, -1):
        at = live[top[live] > k]
        total[at[same(k, at)]] += 1 << k
    return total


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1: up and down a tree of minima."""
    n, far = len(x), np.iinfo(np.int64).max
    tree = [x]
    while len(tree[-1]) > 1:
        row = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], far)
        tree.append(np.minimum(row[::2], row[1::2]))
    node, level = np.full(n, -1), np.full(n, -1)
    live = np.arange(n)
    for k in range(len(tree)):
        at = live >> k
        hit = (at & 1 == 1) & (tree[k][np.maximum(at - 1, 0)] < x[live])
        node[live[hit]], level[live[hit]] = at[hit] - 1, k
        live = live[~hit]
        live = live[live >> k > 0]
        if not len(live):
            break
    for k in range(int(level.max(initial=0)), 0, -1):
        at = np.flatnonzero(level >= k)
        right = 2 * node[at] + 1
        row = tree[k - 1]
        node[at] = np.where((right < len(row)) & (row[np.minimum(right, len(row) - 1)] < x[at]), right, right - 1)
    return node


def previous_factors(order: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor from each place on that also starts before it."""
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    before = smaller_before(order)
    after = n - 1 - smaller_before(order[::-1])[::-1]
    for near in (before, after):
        slot = np.flatnonzero((near >= 0) & (near < n))
        i, j = order[slot], order[near[slot]]
        got = common(names, i, j)
        more = got > length[i]
        length[i[more]], source[i[more]] = got[more], j[more]
    return length, source


def at_boundaries(names: np.ndarray, starts: np.ndarray, n: int, least: int, times: int) -> np.ndarray:
    """Runs (start, end, period) that touch the start of a block of the parse; ends are exclusive."""
    size = np.diff(np.append(starts, n))
    most = (size[:-1] + size[1:] - 1) // (times - 1)
    b = np.repeat(starts[1:], most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    for left in (False, True):
        a = b - p if left else b  # the run, if any, holds a and a + p
        ok = (a >= 0) & (a + p < n)
        if times >= 4:  # then one side of the boundary holds two whole periods
            first = b - 2 * p if left else b
            ok &= (first >= 0) & (first + 2 * p <= n)
            k = np.frexp(p)[1] - 1
            ok &= k < len(names)
            q, f, k = p[ok], first[ok], k[ok]
            late = q - (1 << k)
            square = (names[k, f] == names[k, f + q]) & (names[k, f + late] == names[k, f + late + q])
            ok[ok] = square
        a, q = a[ok], p[ok]
        ahead, behind = common(names, a, a + q), common(names, a - 1, a + q - 1, True)
        found.append(np.stack([a - behind, a + q + ahead, q], 1))
    runs = np.concatenate(found)
    span = runs[:, 1] - runs[:, 0]
    runs = runs[span >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])[: len(runs)]]  # of one stretch the least period


def copied(runs: np.ndarray, starts: list[int], sizes: list[int], sources: list[int], least: int) -> list[tuple[int, int, int]]:
    """The given runs and those inside of blocks, by start. Blocks (start, size, source) by start."""
    new, done, at = runs.tolist(), [], 0
    places: list[int] = []  # starts of ``done``
    def put(upto: int) -> None:
        nonlocal at
        while at < len(new) and new[at][0] < upto:
            done.append(tuple(new[at]))
            places.append(new[at][0])
            at += 1

    for b, size, source in zip(starts, sizes, sources, strict=True):
        if size < least + 2:
            continue
        put(b + 1)
        k, shift = bisect_right(places, source), b - source
        while True:
            if k == len(done):  # the source may reach into the block itself
                if at < len(new) and new[at][0] < source + size:
                    put(new[at][0] + 1)
                    continue
                break
            s, e, p = done[k]
            if s >= source + size:
                break
            if e < source + size:
                put(s + shift + 1)
                done.append((s + shift, e + shift, p))
                places.append(s + shift)
            k += 1
    put(1 << 62)
    return done


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs of symbols, by start and period. The first and the last symbol occur once."""
    n = len(x)
    order, names = suffixes(x)
    none = np.zeros((0, 3), np.int64)
    if not len(names):
        return none
    length, source = previous_factors(order, names)
    starts, step, i = [], np.maximum(length, 1).tolist(), 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts)
    found = at_boundaries(names, first, n, least, times)
    if not len(found):
        return none  # what lies inside of a block has a first occurrence that doesn't
    long = first[length[first] >= least + 2]
    found = np.array(copied(found, long.tolist(), length[long].tolist(), source[long].tolist(), least), np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one id in ten, the places that the words come from when its text is made periodic from some word on; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _block(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """Runs of each of the texts."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts])
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
    at = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1  # of each text, after its mark
    x = np.full(at[-1], -1)
    x[np.arange(len(ids)) + np.repeat(np.arange(len(texts)) + 1, sizes)] = ids
    x[at - 1] = len(known) + np.arange(len(texts) + 1)
    runs = runs_of(x, least, times)
    owner = np.searchsorted(at, runs[:, 0], side="right") - 1
    runs[:, :2] -= at[owner][:, None]
    return np.split(runs, np.searchsorted(owner, np.arange(1, len(texts))))


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES, source=None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs by start and period, collapsed: the words outside of repeats, joined by one space.

    ``source`` may name, from the number of words and the id, the places that a text's words are taken from.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column("doc_id"), part.column("text").cast(pa.binary())
            first, size, held = 0, 0, []

            def batch() -> pa.RecordBatch:
                rows, offsets, kept = [], [0], []
                for words, runs in zip(held, _block(held, least, times), strict=True):  # noqa: B023
                    if len(runs):
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(cover, runs[:, 1], -1)
                        stay = np.cumsum(cover)[:-1] == 0
                        words = compress(words, stay.tolist())
                        rows.append(np.stack([runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]], 1))
                    offsets.append(offsets[-1] + len(runs))
                    kept.append(b" ".join(words))
                flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
                made = [ids.slice(first, len(held)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields, type=kind), pa.array(kept, pa.binary()).cast(pa.string())]  # noqa: B023
                return pa.RecordBatch.from_arrays(made, names=["doc_id", "runs", "collapsed"])

            for k in range(len(part)):
                words = (texts[k].as_py() or b"").split()  # at the six white-space bytes of ASCII
                places = source(len(words), ids[k].as_py()) if source else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                if held and size + len(words) > BLOCK:
                    yield batch()
                    first, size, held = k, 0, []
                held.append(words)
                size += len(words)
            if held:
                yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def greatest(runs: Column) -> Column:
    """The run of greatest length / period, the first of several; null where there is none."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11: one text in ten is made periodic first."""
    found = periodic(spark.read.parquet(f"{sf_dir}/documents.parquet"), source=rewritten).withColumn("top", greatest(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words at a distance that four periods allow; stretches of them without a gap are runs.
ORACLE = r"""
WITH w0 AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda acc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384) + z, xor(acc, b)), 4294967295) AS c
  FROM documents),
w1 AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h FROM w0),
w2 AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM w2),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM w3),
x AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS t FROM d),
y AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.t = b.t AND b.i > a.i AND b.i - a.i <= a.n // 4),
z AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM y),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM z GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
k AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
o AS (SELECT r, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS o FROM u) WHERE o = 1),
c AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
j AS (SELECT x.r, string_agg(x.t, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN c ON x.r = c.r AND x.i = c.i WHERE c.r IS NULL GROUP BY x.r)
SELECT d.doc_id, CAST(coalesce(k.n_runs, 0) AS BIGINT) AS n_runs, CAST(o.start AS BIGINT) AS start, CAST(o.length AS BIGINT) AS length, CAST(o.period AS BIGINT) AS period,
  CAST(1000 * o.length // o.period AS BIGINT) AS exponent_milli, sha256(coalesce(k.lines, '')) AS runs_sha256, sha256(coalesce(j.t, '')) AS collapsed_sha256
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN o ON d.r = o.r LEFT JOIN j ON d.r = j.r
"""
