"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last 16 bytes ends a chunk where it falls under a bound, if no such place lies in the 11 bytes
before. Whether a place ends a chunk depends on the bytes just before it alone, so chunks fall in step again right after
an insertion, and a passage is cut alike wherever it stands. Text that repeats a few bytes without end has no such place;
there a chunk ends after LONGEST bytes. Chunks are compared by the digest of the chunk and the one after it, about 70
bytes: a short run of common words never matches by itself. The least doc_id that has a digest keeps it; elsewhere it is
a repeat. Overlapping and touching repeats of a row merge into spans; a span counts where one keeper has at least
``min_words`` word starts of it. A repeat loses the pieces before its first and after its last chunk end, so passages of
over 50 words leave spans well above the default bound of 16.

Digests are aggregated before the shuffle, and marking is an equi-join that Spark can split, so neither a digest in a
third of all documents nor a source with a third of all rows meets in one task. Spans are merged for each row, told
apart by a hash of its doc_id and text, so rows that share an id, or have none, are spread as well.

Defined results for odd input: null and empty texts have no chunk; a text without a chunk end is one chunk; repeats inside
one doc_id don't count, be they in one row or in several (these are one document to this operator), but spans and cuts are
those of each row; equal rows have the same spans, given once; rows with a null doc_id never keep a digest that another
document has, and repeats among them don't count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm import words
from treeline.session import written

NAME = "op1_substring_dedup"
MIN_WORDS = 16
GAP = 12
REACH = 16
LONGEST = 512
GEAR = (words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(words.P)) >> np.uint64(32)).astype(np.uint32)
BOUND = np.uint32((1 << 32) // 20)


def ends(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Places in a block after which a chunk ends, without the ends of texts."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        late = h.copy()
        late[k:] += h[:-k] << np.uint32(k)
        h = late
    low = (h * np.uint32(0x9E3779B1)) < BOUND
    low[:-1] &= (data[1:] & 0xC0) != 0x80  # between code points
    head = text_at[:-1, None] + np.arange(REACH)  # its window would reach into the text before
    low[np.minimum(head, len(data) - 1)] = False
    at = np.flatnonzero(low)
    if len(at):
        at = at[np.concatenate([[True], np.diff(at) >= GAP])]
    return at


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: text index, digest, first and last code point, first and last word of each chunk with its next."""
    for b in words.blocks(texts, words.SPACE, words.AS_IS):
        at = ends(b.raw, b.text_at)
        stop_of = b.text_at[1:] - 1  # without the separator
        full = stop_of > b.text_at[:-1]
        cut = np.unique(np.concatenate([at + 1, stop_of[full]]))
        owner = np.searchsorted(b.text_at, cut, side="left") - 1
        keep = cut <= stop_of[owner]
        cut, owner = cut[keep], owner[keep]
        if not len(cut):
            continue
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        start = np.where(first, b.text_at[owner], np.concatenate([[0], cut[:-1]]))
        long = np.flatnonzero(cut - start > LONGEST)
        if len(long):
            forced = np.concatenate([np.arange(start[k] + LONGEST, cut[k], LONGEST) for k in long])
            for _ in range(3):  # to the next code point
                forced += (b.raw[forced] & 0xC0) == 0x80
            cut = np.unique(np.concatenate([cut, forced]))
            owner = np.searchsorted(b.text_at, cut, side="left") - 1
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            start = np.where(first, b.text_at[owner], np.concatenate([[0], cut[:-1]]))
        down = words.powers(len(b.data) + 1)[1]
        digest = words.mix((b.total[cut] - b.total[start]) * down[start] + (cut - start).astype(np.uint64))
        last = np.concatenate([first[1:], [True]])
        following = np.where(last, np.uint64(0), np.concatenate([digest[1:], digest[:1]]))
        end = np.where(last, cut, np.concatenate([cut[1:], cut[:1]]))
        use = ~last | first
        points = np.concatenate([[0], np.cumsum((b.raw & 0xC0) != 0x80)])
        begun = np.zeros(len(b.raw) + 1, np.int64)
        begun[b.start + 1] = 1
        begun = np.cumsum(begun)
        start, end, owner = start[use], end[use], owner[use]
        base, base_words = b.text_at[owner], begun[b.text_at[owner]]
        yield b.first + owner, words.mix(digest[use] + words.mix(following[use])), points[start] - points[base], points[end] - points[base], begun[start] - base_words, begun[end] - base_words


def chunker(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, hashes = part.column("doc_id"), part.column("text_hash")
        for owner, digest, a, z, u, v in chunks(part.column("text").to_pylist()):
            pack = lambda x, y: pa.array(x.astype(np.int64) << 32 | y.astype(np.int64))
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), ids.take(at), hashes.take(at), pack(a, z), pack(u, v)], names=["digest", "doc_id", "text_hash", "span", "words"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, start, end (code points), n_words, first_doc_ids: spans that a document of lower id has.

    text_hash, xxhash64 of doc_id and text, tells rows of one id apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("text_hash"), "text")
    made = written(rows.mapInArrow(chunker, "digest long, doc_id long, text_hash long, span long, words long"), "chunks")
    several = made.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("unnamed")).where("lo <> hi OR (unnamed AND lo IS NOT NULL)").select("digest", "lo")
    half = (1 << 32) - 1
    found = (
        made.join(several, "digest").where("NOT doc_id <=> lo")
        .select("doc_id", "text_hash", "lo", F.shiftrightunsigned("span", 32).alias("a"), F.col("span").bitwiseAND(half).alias("z"), F.shiftrightunsigned("words", 32).alias("u"), F.col("words").bitwiseAND(half).alias("v"))
    )
    found = found.distinct()  # equal rows have equal spans: so a row that occurs a million times is one here
    row = ["doc_id", "text_hash"]
    by_place = W.partitionBy(*row).orderBy("a", "z")
    found = found.withColumn("new", (F.col("a") > F.coalesce(F.max("z").over(by_place.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    found = found.withColumn("run", F.sum("new").over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    by_owner = found.groupBy(*row, "run", "lo").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("u").alias("u"), F.max("v").alias("v")).where(F.col("v") - F.col("u") >= min_words)
    spans = by_owner.groupBy(*row, "run").agg(F.min("a").alias("start"), F.max("z").alias("end"), (F.max("v") - F.min("u")).alias("n_words"), F.array_sort(F.collect_set("lo")).alias("first_doc_ids"))
    return spans.select(*row, "start", "end", "n_words", "first_doc_ids")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated span cut out of ``text``; all columns stay."""
    spans = repeats(docs, min_words).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut")).alias("s")
    k_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k_id.alias("k_id"), F.xxhash64(k_id, "text").alias("k_text")).alias("r")
    text = F.col("row.text")
    piece = lambda acc, c: F.substring(text, acc["at"].cast("int") + 1, (c["start"] - acc["at"]).cast("int"))
    kept = F.concat(
        F.aggregate("cut", F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")), lambda acc, c: F.struct(F.concat(acc["s"], piece(acc, c)).alias("s"), c["end"].alias("at")), lambda acc: acc["s"]),
        F.substring(text, F.element_at("cut", -1)["end"].cast("int") + 1, F.lit(2**31 - 1)),
    )
    found = rows.join(spans, F.expr("r.k_text = s.text_hash AND r.k_id <=> s.doc_id"), "left")
    return found.withColumn("row", F.col("row").withField("text", F.when(F.col("cut").isNull(), text).otherwise(kept))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
