"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by the MD5 of their id and text. A document's *virtual finish time* in pass e is
``(e * source_size + words of its source up to and including it) / target``. All passes of all documents are put in
the order of that time, and the mix takes them while the running total stays within the budget.

No window spans a source: running totals inside a source are the total of the lower hash buckets plus a window inside
one bucket, so a source that holds a third of all rows is spread over thousands of groups. The global cut is found the
same way, from a histogram of virtual times and one window inside the histogram bucket that the budget falls into.

Defined results for odd input:

* null or empty text: size 0, and taken 0;
* null source: a source of its own, last in the order; null doc_id: shuffled as the empty string, by the text then;
* repeated rows: each is a document with a finish time of its own, so that of many equal rows as many are taken as the
  target asks for; which of them makes no difference;
* very long texts: read whole; a document is taken or left as one, so a source's words come within a document of the target;
* empty table: no rows; a table without a word: target 0, taken 0;
* more columns, also with names used here: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.plans.splits import numbered
from treeline.session import written

NAME = "op4_mix_sources"
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 3  # of the MD5 in hex: 4,096 buckets in each source
TIME_BUCKETS = 65536  # in one unit of virtual time, in which about the whole budget is spent


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), passes: int = 3) -> DataFrame:
    """sizes(source, source_size) -> + target: shares of the total by weight, at most ``passes`` times the source's size.

    Filling up to a common level gives what resharing the excess again and again gives: by rising cap over weight, the
    first source whose cap is not below the level of what is left fixes the level of all that follow.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("rest", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("common", F.min(F.when(F.col("level") >= F.col("rest"), F.struct("level", "source", "rest"))).over(everything)["rest"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("common")).alias("target"))
    )


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), passes: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, taken, and h and copy, which tell rows of one id and text apart."""
    h = shuffle_key(F.col(id_col), F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"), h.alias("h"))
    sized = written(sizes.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("copies")).withColumn("hb", F.substring("h", 1, HASH_DIGITS)), "mix-sizes")
    by_bucket = sized.groupBy("source", "hb").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, passes)
    lower = W.partitionBy("source").orderBy("hb").rowsBetween(W.unboundedPreceding, -1)
    b, t = by_bucket.withColumn("lower", F.coalesce(F.sum("words").over(lower), F.lit(0))).alias("b"), targets.alias("t")
    buckets = b.join(t, F.expr("b.source <=> t.source")).select("b.source", "hb", "lower", "source_size", "target").alias("b")
    s = sized.alias("s")
    inside = W.partitionBy("source_key", "hb").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    queued = written(
        s.join(buckets, F.expr("s.hb = b.hb AND s.source <=> b.source"))
        .select("s.doc_id", "s.size", "s.h", "s.hb", "s.copies", F.struct("s.source").alias("source_key"), "source_size", "target", "lower")
        .withColumn("before", F.col("lower") + before)
        .select("doc_id", "source_key.source", "size", "h", "source_size", "target", "before", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .withColumn("upto", F.col("before") + F.col("copy") * F.col("size"))
        .drop("before"),
        "mix-queue",
    )
    finish = lambda e: (F.col("upto") + e * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
    key = lambda e: F.struct(finish(e).alias("v"), F.col("h"), F.lit(e).alias("e"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size"))
    each = queued.where("size > 0 AND target > 0").select(F.explode(F.array(*[key(e) for e in range(passes)])).alias("k")).select("k", F.least(F.floor(F.col("k.v") * TIME_BUCKETS), F.lit(4 * TIME_BUCKETS)).alias("vb"))
    level = W.orderBy("vb").rowsBetween(W.unboundedPreceding, W.currentRow)
    histogram = each.groupBy("vb").agg(F.sum("k.size").alias("words")).withColumn("upto", F.sum("words").over(level))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    reached = histogram.crossJoin(F.broadcast(budget)).where("upto > budget").agg(F.min(F.struct("vb", (F.col("upto") - F.col("words")).alias("below"), "budget")).alias("r")).select("r.*")
    run = F.sum("k.size").over(W.partitionBy("vb").orderBy("k"))  # by value: what finishes together in all of k, in two sources, is taken alike
    cut = each.join(F.broadcast(reached), "vb").withColumn("total", F.col("below") + run).where("total > budget").agg(F.min("k").alias("cut"))
    passes_taken = sum((F.coalesce((F.col("cut").isNull() | (key(e) < F.col("cut"))) & (F.col("target") > 0), F.lit(False)).cast("long") for e in range(passes)), F.lit(0).cast("long"))
    return queued.crossJoin(F.broadcast(cut)).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * passes_taken).alias("taken"), "h", "copy")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def mixed(docs: DataFrame) -> DataFrame:
    """docs -> its rows that the mix takes, all columns, with size, and taken: size times the passes over the row.

    Columns of docs that are named size or taken, in any case, give way to these. Rows equal in source, id and text are taken
    alike but where the end of the mix falls among them, which it does once a source and pass; these are numbered, by ranges.
    """
    plan, key = mix(docs).withColumn("k", F.struct("doc_id", "source", "h")), lambda a, b: F.expr(f"{a}.k.h = {b}.k.h AND {a}.k.doc_id <=> {b}.k.doc_id AND {a}.k.source <=> {b}.k.source")
    kept = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("size", "taken")]
    keyed = docs.select(F.struct(*kept).alias("row"), F.struct("doc_id", "source", shuffle_key(F.col("doc_id"), F.col("text")).alias("h")).alias("k")).alias("d")
    groups = plan.groupBy("k").agg(F.min("taken").alias("least"), F.max("taken").alias("taken"), F.first("size").alias("size"))
    whole = groups.where("least = taken AND taken > 0").alias("g")
    out = keyed.join(whole, key("d", "g")).select("d.row.*", "g.size", "g.taken")
    torn = groups.where("least < taken").alias("g")
    if torn.limit(1).count():
        rows = written(keyed.join(torn, key("d", "g")).select("d.row", "d.k", F.xxhash64("d.k").alias("of"), F.monotonically_increasing_id().alias("at")), "torn")
        placed = numbered(rows, "of", "at")
        first = placed.groupBy("of").agg(F.min("index").alias("first"))
        d = placed.join(F.broadcast(first), "of").withColumn("copy", F.col("index") - F.col("first") + 1).alias("d")
        p = plan.where("taken > 0").alias("p")
        out = out.unionByName(d.join(p, key("d", "p") & F.expr("d.copy = p.copy")).select("d.row.*", "p.size", "p.taken"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "h", "copy")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM s),
l AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS level FROM w),
r AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM l),
c AS (SELECT rest AS common FROM r WHERE level >= rest ORDER BY level, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * common) AS target FROM r, c),
q AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.source, d.size, d.h, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CAST(upto + e * source_size AS DOUBLE) / target AS v
  FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE target > 0),
o AS (
  SELECT r, e, sum(size) OVER (ORDER BY v, h, e, coalesce(CAST(doc_id AS VARCHAR), ''), size) AS total FROM k),
n AS (SELECT r, count(DISTINCT e) AS passes FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.passes, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.r = n.r
"""
