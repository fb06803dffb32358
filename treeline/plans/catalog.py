"""The registered queries of the spanning-tree engine and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.__main__ import main
from treeline.functions import geometry as G
from treeline.operators import components as C
from treeline.operators.contraction import TASK_ROWS, spanning_forest
from treeline.operators.mst import local_trees, merge_round, mst, nearest_neighbors
from treeline.operators.pairs import pairs, pairs_across, pairs_within
from treeline.operators.spatial import spatial_mst
from treeline.plans.splits import members, n_subgraphs, numbered, schedule, subgraphs, with_splits
from treeline.session import shared_dir
from treeline.sources import matrix, sequence
from treeline.sources.tables import read_splits, read_vectors, save_splits

SPLITS, FANIN, HEIGHT = 4, 3, 1.17


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read_vectors(spark, f"{d}/part.parquet", "p_partkey", "p_size", "p_retailprice")


def rounded(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.round("weight", 6))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return mst(vectors(spark, d), SPLITS, FANIN)


def points_scan(spark, d):
    return vectors(spark, d).select("id", G.dimension(F.col("coords")).alias("d"), F.round(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def points_prefix(spark, d):
    p = vectors(spark, d).where("id < 100").withColumn("coords", G.prefix(F.col("coords"), 5))
    return p.select("id", *[F.round(F.col("coords")[k], 6).alias(f"x{k}") for k in range(5)])


def point_hash(spark, d):
    return parts(spark, d).select("id", G.point_hash(F.col("id"), F.col("coords")).alias("hash"))


def point_format(spark, d):
    return parts(spark, d).select("id", G.point_string(F.col("id"), F.col("coords")).alias("shown"))


def point_format_plain(spark, d):
    return parts(spark, d).select("id", G.plain_string(F.col("id"), F.col("coords")).alias("shown"))


def point_equals(spark, d):
    """Each point against itself, and against the one half a table further."""
    p = parts(spark, d)
    other = p.select(F.col("id").alias("other"), F.col("coords").alias("b"))
    asked = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).withColumn("other", F.pmod(F.col("id") - 1 + F.floor(F.col("n") / 2), "n") + 1)
    same = lambda i, c: G.point_equals(F.col("id"), F.col("coords"), i, c)
    return asked.join(other, "other").select("id", same(F.col("id"), F.col("coords")).alias("itself"), same(F.col("other"), F.col("b")).alias("another"), same(F.col("id"), F.col("b")).alias("same_id"))


def edge_format(spark, d):
    """Two coordinates, so the tree comes by blocks of a kd-tree, and its work grows about as the points."""
    return spatial_mst(parts_small(spark, d)).select("src", "dst", G.edge_string(F.col("src"), F.col("dst"), F.col("weight")).alias("shown"))


def parts_small(spark, d):
    return read_vectors(spark, f"{d}/supplier.parquet", "s_suppkey", "s_nationkey", "s_acctbal")


def swap_bytes(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), G.swap_bytes(F.col("p_partkey")).alias("swapped"))


def split_assign(spark, d):
    return with_splits(vectors(spark, d), 7).select("id", "split")


def split_sizes(spark, d):
    return split_sizes_of(with_splits(vectors(spark, d), 7))


def subgraph_plan(spark, d):
    """Every subgraph with the points on its left and right, and the edges that it has."""
    sizes = split_sizes_of(with_splits(vectors(spark, d), SPLITS))
    left, right = (sizes.select(F.col("split").alias(k), F.col("n_points").alias(f"n_{k}")) for k in "lr")
    n = F.when(F.col("kind") == "complete", F.col("n_l") * (F.col("n_l") - 1) / 2).otherwise(F.col("n_l") * F.col("n_r")).cast("long")
    return subgraphs(spark, SPLITS).join(F.broadcast(left), "l").join(F.broadcast(right), "r").select("sg", "l", "r", "kind", "n_l", "n_r", n.alias("n_edges"))


def split_sizes_of(points: DataFrame) -> DataFrame:
    return points.groupBy("split").agg(F.count("*").alias("n_points"))


def subgraph_sizes(spark, d):
    return members(with_splits(vectors(spark, d), SPLITS), SPLITS).groupBy("sg").agg(F.count("*").alias("n_points"))


def fanin_schedule(spark, d):
    """For each round of merges the trees that there are and the points of the largest one."""
    placed = members(with_splits(vectors(spark, d), SPLITS), SPLITS).select("sg", "id")
    rounds = spark.createDataFrame([(k, FANIN**k) for k in range(len(schedule(SPLITS, FANIN)))], "round int, of int")
    held = placed.crossJoin(F.broadcast(rounds)).groupBy("round", F.floor(F.col("sg") / F.col("of")).alias("grp")).agg(F.count_distinct("id").alias("n"))
    return held.groupBy("round").agg(F.count("*").cast("int").alias("groups"), F.max("n").alias("most_points"))


def all_pairs(p: DataFrame, found=pairs) -> DataFrame:
    n = p.count()
    return found(with_splits(p, SPLITS, n), SPLITS, n=n, digits=6)


def pairwise_distance(spark, d):
    return all_pairs(vectors(spark, d))


def bipartite_pairs(spark, d):
    """The distances of all bipartite subgraphs."""
    return all_pairs(vectors(spark, d), pairs_across)


def mono_pairs(spark, d):
    """The distances of all complete subgraphs."""
    return all_pairs(vectors(spark, d), pairs_within)


def nearest_neighbor(spark, d):
    return rounded(nearest_neighbors(vectors(spark, d), SPLITS))


def local(spark, d, kind=None):
    return local_trees(with_splits(vectors(spark, d), SPLITS), SPLITS, kind=kind)


def local_mst_bipartite(spark, d):
    return rounded(local(spark, d, "bipartite"))


def local_mst_complete(spark, d):
    return rounded(local(spark, d, "complete"))


def local_mst_stats(spark, d):
    return local(spark, d).groupBy("sg").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("total"))


def merge_round_1(spark, d):
    groups = -(-n_subgraphs(SPLITS) // FANIN)
    return rounded(merge_round(local(spark, d).withColumnRenamed("sg", "grp"), FANIN, groups))


def mst_edges(spark, d):
    return rounded(tree(spark, d))


def mst_contracted(spark, d):
    """The tree by contraction from the local trees: a task may hold 200 edges, so there are several rounds."""
    return rounded(mst(vectors(spark, d), SPLITS, FANIN, task_rows=200))


def forest_of_pairs(spark, d):
    """The minimum spanning forest of the nearest neighbours' edges."""
    near = nearest_neighbors(vectors(spark, d), SPLITS)
    return rounded(spanning_forest(near.select(F.least("id", "near").alias("src"), F.greatest("id", "near").alias("dst"), "weight").distinct(), 0))


def mst_spatial(spark, d):
    """The tree of the parts' sizes and prices by blocks of a kd-tree, of some 64 points each."""
    return rounded(spatial_mst(parts(spark, d), block_rows=64))


def mst_ties(spark, d):
    return rounded(mst(read_vectors(spark, f"{d}/part.parquet", "p_partkey", "p_size"), SPLITS, FANIN))


def mst_weight(spark, d):
    return tree(spark, d).agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("total"))


def mst_topk_heaviest(spark, d):
    return rounded(tree(spark, d).orderBy(F.desc("weight"), "src", "dst").limit(10))


def component_count(spark, d):
    return C.component_count(vectors(spark, d).select("id"), C.cut_at(tree(spark, d), HEIGHT))


def component_root(spark, d):
    return C.component_roots(vectors(spark, d).select("id"), C.cut_at(tree(spark, d), HEIGHT), TASK_ROWS)


def is_connected(spark, d):
    ids = vectors(spark, d).select("id")
    pairs = ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % F.col("n")).alias("b"))
    return C.connected(pairs, component_root(spark, d))


def single_linkage_labels(spark, d):
    return C.labels_of(vectors(spark, d).select("id"), tree(spark, d), 10, TASK_ROWS)


def dendrogram_merges(spark, d):
    return rounded(C.merges(tree(spark, d)))


def saved_splits(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    save_splits(with_splits(vectors(spark, d), SPLITS), path)
    return path


def split_roundtrip(spark, d):
    return read_splits(spark, saved_splits(spark, d), 1, 3).select("id", "split", G.dimension(F.col("coords")).alias("d"))


def splits_all(spark, d):
    return read_splits(spark, saved_splits(spark, d)).select("id", "split", F.round(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def matrix_scan(spark, d):
    """The vectors written as a folder of binary matrices, and read by ranges of 16 KB through Hadoop, several a file."""
    uri = f"{shared_dir(spark).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    matrix.write_parts(vectors(spark, d), uri, 3)
    points = matrix.read_matrix(spark, uri, split_bytes=1 << 14)
    return points.select("id", G.dimension(F.col("coords")).alias("d"), F.round(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def sequence_roundtrip(spark, d):
    """The parts written as block-compressed sequence files, and read back."""
    uri = f"{shared_dir(spark).rstrip('/')}/points-{uuid.uuid4().hex}.seq"
    sequence.write_points(parts(spark, d), uri, "block")
    return sequence.read_points(spark, uri).select("id", G.plain_string(F.col("id"), F.col("coords")).alias("shown"))


def sample_display(spark, d):
    """The first five points, as the commands show them."""
    return parts(spark, d).orderBy("id").limit(5).select("id", G.point_string(F.col("id"), F.col("coords")).alias("shown"))


def paired_display(spark, d):
    """Points and what was read back of their splits, side by side by position."""
    p = parts(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    save_splits(with_splits(p, SPLITS), path)
    shown = lambda df, name: numbered(df.select("id", "coords"), "id").select("index", G.point_string(F.col("id"), F.col("coords")).alias(name))
    return shown(p, "left").join(shown(read_splits(spark, path), "right"), "index", "full")


def run_command(spark, d):
    """What ``python -m treeline`` writes for the vectors."""
    out = f"{shared_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    main([f"{d}/embeddings.parquet", "--id", "vec_id", "--coords", "embedding", "--splits", str(SPLITS), "--out", out])
    return rounded(spark.read.parquet(out))


def split_command(spark, d):
    """What ``python -m treeline split`` writes for the vectors."""
    out = f"{shared_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    main(["split", f"{d}/embeddings.parquet", "--id", "vec_id", "--coords", "embedding", "--splits", "7", "--out", out, "--show", "0"])
    return read_splits(spark, out).select("id", "split")


QUERIES = {
    f.__name__: f
    for f in (
        mst_edges, mst_contracted, mst_spatial, forest_of_pairs, mst_weight, mst_topk_heaviest, mst_ties, points_scan, matrix_scan, points_prefix, point_hash, point_equals, point_format, point_format_plain, edge_format, swap_bytes, split_assign, split_sizes, subgraph_plan, subgraph_sizes, fanin_schedule,
        pairwise_distance, bipartite_pairs, mono_pairs, nearest_neighbor, local_mst_bipartite, local_mst_complete, local_mst_stats, merge_round_1, component_count, component_root, is_connected, single_linkage_labels, dendrogram_merges, split_roundtrip, splits_all,
        sequence_roundtrip, sample_display, paired_display, run_command, split_command,
    )
}

# Oracles. ``p`` has points, ``g`` both directions of every edge with its subgraph; Prim keeps one row for each vertex
# outside the tree and marks the next.
EMB = "p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
SPLIT = f"s AS MATERIALIZED (SELECT id, v, CAST(floor((i * {SPLITS} - 1) / n) AS INT) AS k FROM (SELECT *, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS n FROM p))"


def prim_sql(graph: str, vertices: str) -> str:
    """CTEs up to t(sg, src, dst, weight), from g(sg, u, v, w) and vertices(sg, id)."""
    order = "ORDER BY {0}, least({1}, v), greatest({1}, v)"
    return f"""{graph}, vs AS MATERIALIZED ({vertices}),
 f(sg, v, key, par, pick) AS (
  SELECT a.sg, a.id, coalesce(g.w, 'inf'::DOUBLE), z.u, row_number() OVER (PARTITION BY a.sg ORDER BY coalesce(g.w, 'inf'::DOUBLE), least(z.u, a.id), greatest(z.u, a.id)) = 1
  FROM vs a JOIN (SELECT sg, min(id) AS u FROM vs GROUP BY sg) z ON a.sg = z.sg AND a.id <> z.u LEFT JOIN g ON g.sg = a.sg AND g.u = z.u AND g.v = a.id
  UNION ALL
  SELECT sg, v, key, par, row_number() OVER (PARTITION BY sg {order.format("key", "par")}) = 1 FROM (
   SELECT f.sg, f.v, CASE WHEN x.lt THEN y.w ELSE f.key END AS key, CASE WHEN x.lt THEN q.v ELSE f.par END AS par
   FROM f JOIN f q ON q.pick AND q.sg = f.sg LEFT JOIN g y ON y.sg = f.sg AND y.u = q.v AND y.v = f.v,
        LATERAL (SELECT coalesce((y.w, least(y.u, y.v), greatest(y.u, y.v)) < (f.key, least(f.par, f.v), greatest(f.par, f.v)), false) AS lt) x
   WHERE NOT f.pick)),
 t AS MATERIALIZED (SELECT sg, least(par, v) AS src, greatest(par, v) AS dst, key AS weight FROM f WHERE pick AND key < 'inf'::DOUBLE)"""


def whole_sql(points: str) -> str:
    return "WITH RECURSIVE " + points + ", " + prim_sql("g AS MATERIALIZED (SELECT 0 AS sg, a.id AS u, b.id AS v, list_distance(a.v, b.v) AS w FROM p a JOIN p b ON a.id <> b.id)", "SELECT 0 AS sg, id FROM p")


TREE = whole_sql(EMB)
PLAN = f"""sgs AS (SELECT CAST(l.i + r.i * (r.i - 1) // 2 AS INT) AS sg, CAST(l.i AS INT) AS l, CAST(r.i AS INT) AS r FROM range({SPLITS}) l(i) JOIN range({SPLITS}) r(i) ON l.i < r.i
  UNION ALL SELECT CAST({SPLITS * (SPLITS - 1) // 2} + i AS INT), CAST(i AS INT), CAST(i AS INT) FROM range({SPLITS}) d(i))"""
LOCAL = "WITH RECURSIVE " + ", ".join([EMB, SPLIT, PLAN]) + ", " + prim_sql(
    """g AS MATERIALIZED (SELECT sgs.sg, a.id AS u, b.id AS v, list_distance(a.v, b.v) AS w FROM sgs JOIN s a ON a.k IN (l, r) JOIN s b ON b.k IN (l, r) AND a.id <> b.id AND (l = r OR a.k <> b.k))""",
    "SELECT sg, id FROM sgs JOIN s ON s.k IN (l, r)",
)
MERGED = f"""WITH RECURSIVE {", ".join([EMB, SPLIT, PLAN])}, """ + prim_sql(
    f"""g AS MATERIALIZED (SELECT DISTINCT CAST(sgs.sg // {FANIN} AS INT) AS sg, a.id AS u, b.id AS v, list_distance(a.v, b.v) AS w FROM sgs JOIN s a ON a.k IN (l, r) JOIN s b ON b.k IN (l, r) AND a.id <> b.id AND (l = r OR a.k <> b.k))""",
    f"SELECT DISTINCT CAST(sg // {FANIN} AS INT) AS sg, id FROM sgs JOIN s ON s.k IN (l, r)",
)
ROOTS = f""", e AS MATERIALIZED (SELECT src AS a, dst AS b FROM t WHERE weight <= {HEIGHT} UNION ALL SELECT dst, src FROM t WHERE weight <= {HEIGHT}),
 r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
 roots AS MATERIALIZED (SELECT id, max(root) AS root FROM r GROUP BY id)"""
CUT_K = """, e AS MATERIALIZED (SELECT src AS a, dst AS b FROM k UNION ALL SELECT dst, src FROM k),
 r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)"""
PAIRS = "a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 6) AS weight"

ORACLES = {
    "mst_edges": TREE + " SELECT src, dst, round(weight, 6) AS weight FROM t",
    "mst_contracted": TREE + " SELECT src, dst, round(weight, 6) AS weight FROM t",
    "mst_spatial": whole_sql("p AS MATERIALIZED (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice] AS v FROM part)") + " SELECT src, dst, round(weight, 6) AS weight FROM t",
    # Edges of nearest neighbours that have no cycle (ties go to the least id) are their own forest.
    "forest_of_pairs": f"WITH {EMB}, d AS (SELECT a.id, b.id AS near, list_distance(a.v, b.v) AS w FROM p a JOIN p b ON a.id <> b.id), m AS (SELECT id, min({{'w': w, 'near': near}}) AS m FROM d GROUP BY id) SELECT DISTINCT least(id, m.near) AS src, greatest(id, m.near) AS dst, round(m.w, 6) AS weight FROM m",
    "mst_weight": TREE + " SELECT count(*) AS n_edges, round(sum(weight), 4) AS total FROM t",
    "mst_topk_heaviest": TREE + " SELECT src, dst, round(weight, 6) AS weight FROM (SELECT * FROM t ORDER BY weight DESC, src, dst LIMIT 10)",
    # On a line, equal points hang on the least of their ids, and each group's least on that of the next group.
    "mst_ties": "WITH g AS (SELECT p_size AS x, min(p_partkey) AS id FROM part GROUP BY p_size) SELECT g.id AS src, p_partkey AS dst, 0.0::DOUBLE AS weight FROM part JOIN g ON p_size = x WHERE p_partkey <> g.id"
    " UNION ALL SELECT least(id, i), greatest(id, i), (y - x)::DOUBLE FROM (SELECT id, x, lead(id) OVER (ORDER BY x) AS i, lead(x) OVER (ORDER BY x) AS y FROM g) WHERE i IS NOT NULL",
    "points_scan": f"WITH {EMB} SELECT id, CAST(len(v) AS INT) AS d, round(list_sum(v), 6) AS total FROM p",
    "matrix_scan": f"WITH {EMB} SELECT row_number() OVER (ORDER BY id) - 1 AS id, CAST(len(v) AS INT) AS d, round(list_sum(v), 6) AS total FROM p",
    "points_prefix": f"WITH {EMB} SELECT id, " + ", ".join(f"round(v[{k + 1}], 6) AS x{k}" for k in range(5)) + " FROM p WHERE id < 100",
    "point_hash": "SELECT p_partkey AS id, CAST((p_partkey * 163 + 2 * 57 + CAST(trunc(p_size + p_retailprice) AS BIGINT) + 2147483648) % 4294967296 - 2147483648 AS INT) AS hash FROM part",
    "point_format": "SELECT p_partkey AS id, format('{}: [{:.2f}, {:.2f}]', p_partkey, p_size::DOUBLE, p_retailprice) AS shown FROM part",
    "point_format_plain": "SELECT p_partkey AS id, format('{} {:.2f} {:.2f}', p_partkey, p_size::DOUBLE, p_retailprice) AS shown FROM part",
    "point_equals": "WITH n AS (SELECT count(*) AS n FROM part) SELECT a.p_partkey AS id, true AS itself, a.p_partkey = b.p_partkey AND a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice AS another,"
    " a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice AS same_id FROM part a CROSS JOIN n JOIN part b ON b.p_partkey = (a.p_partkey - 1 + n // 2) % n + 1",
    "edge_format": whole_sql("p AS MATERIALIZED (SELECT s_suppkey AS id, [s_nationkey::DOUBLE, s_acctbal] AS v FROM supplier)") + " SELECT src, dst, format('[({} {}) {:.6f}]', src, dst, weight) AS shown FROM t",
    "swap_bytes": "SELECT p_partkey AS id, CAST(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS INT) AS swapped FROM (SELECT p_partkey, (p_partkey % 256) * 16777216 + (p_partkey // 256 % 256) * 65536 + (p_partkey // 65536 % 256) * 256 + p_partkey // 16777216 % 256 AS w FROM part)",
    "split_assign": "SELECT id, CAST(k.i AS INT) AS split FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) x JOIN range(7) k(i) ON x.i >= k.i * n // 7 AND x.i < (k.i + 1) * n // 7",
    "split_sizes": "SELECT CAST(k.i AS INT) AS split, (k.i + 1) * n // 7 - k.i * n // 7 AS n_points FROM range(7) k(i), (SELECT count(*) AS n FROM embeddings)",
    "subgraph_plan": f"WITH {EMB}, {SPLIT}, {PLAN}, z AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT sg, l, r, CASE WHEN l = r THEN 'complete' ELSE 'bipartite' END AS kind, a.n AS n_l, b.n AS n_r, CAST(CASE WHEN l = r THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS n_edges FROM sgs JOIN z a ON a.k = l JOIN z b ON b.k = r",
    "subgraph_sizes": f"WITH {EMB}, {SPLIT}, {PLAN} SELECT sg, count(*) AS n_points FROM sgs JOIN s ON s.k IN (l, r) GROUP BY sg",
    "fanin_schedule": f"""WITH RECURSIVE {EMB}, {SPLIT}, {PLAN}, x(r, sz, g) AS (SELECT 0, 1, {n_subgraphs(SPLITS)} UNION ALL SELECT r + 1, sz * {FANIN}, (g + {FANIN - 1}) // {FANIN} FROM x WHERE g > 1),
 h AS (SELECT x.r, sg // sz AS grp, count(DISTINCT s.id) AS n FROM x CROSS JOIN sgs JOIN s ON s.k IN (l, sgs.r) GROUP BY 1, 2) SELECT CAST(r AS INT) AS round, CAST(count(*) AS INT) AS groups, max(n) AS most_points FROM h GROUP BY r""",
    "pairwise_distance": f"WITH {EMB} SELECT {PAIRS} FROM p a JOIN p b ON a.id < b.id",
    "bipartite_pairs": f"WITH {EMB}, {SPLIT}, {PLAN} SELECT sg, {PAIRS} FROM s a JOIN s b ON a.id < b.id AND a.k <> b.k JOIN sgs ON l = least(a.k, b.k) AND r = greatest(a.k, b.k)",
    "mono_pairs": f"WITH {EMB}, {SPLIT}, {PLAN} SELECT sg, {PAIRS} FROM s a JOIN s b ON a.id < b.id AND a.k = b.k JOIN sgs ON l = a.k AND r = a.k",
    "nearest_neighbor": f"WITH {EMB}, d AS (SELECT a.id, b.id AS near, list_distance(a.v, b.v) AS w FROM p a JOIN p b ON a.id <> b.id) SELECT id, m.near AS near, round(m.w, 6) AS weight FROM (SELECT id, min({{'w': w, 'near': near}}) AS m FROM d GROUP BY id)",
    "local_mst_bipartite": LOCAL + f" SELECT sg, src, dst, round(weight, 6) AS weight FROM t WHERE sg < {SPLITS * (SPLITS - 1) // 2}",
    "local_mst_complete": LOCAL + f" SELECT sg, src, dst, round(weight, 6) AS weight FROM t WHERE sg >= {SPLITS * (SPLITS - 1) // 2}",
    "local_mst_stats": LOCAL + " SELECT sg, count(*) AS n_edges, round(sum(weight), 4) AS total FROM t GROUP BY sg",
    "merge_round_1": MERGED + " SELECT sg AS grp, src, dst, round(weight, 6) AS weight FROM t",
    "component_count": TREE + f" SELECT (SELECT count(*) FROM p) - count(*) AS n_components FROM t WHERE weight <= {HEIGHT}",
    "component_root": TREE + ROOTS + " SELECT id, root FROM roots",
    "is_connected": TREE + ROOTS + " SELECT x.id AS a, y.id AS b, x.root = y.root AS connected FROM roots x JOIN roots y ON y.id = (x.id * 7 + 3) % (SELECT count(*) FROM p)",
    "single_linkage_labels": TREE + ", k AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src DESC, dst DESC) AS i FROM t) WHERE i > 9)" + CUT_K + " SELECT id, max(root) AS label FROM r GROUP BY id",
    "dendrogram_merges": TREE + " SELECT row_number() OVER (ORDER BY weight, src, dst) AS step, src, dst, round(weight, 6) AS weight FROM t",
    "split_roundtrip": f"WITH {EMB}, {SPLIT} SELECT id, k AS split, CAST(len(v) AS INT) AS d FROM s WHERE k IN (1, 3)",
    "sequence_roundtrip": "SELECT p_partkey AS id, format('{} {:.2f} {:.2f}', p_partkey, p_size::DOUBLE, p_retailprice) AS shown FROM part",
    "sample_display": "SELECT p_partkey AS id, format('{}: [{:.2f}, {:.2f}]', p_partkey, p_size::DOUBLE, p_retailprice) AS shown FROM part ORDER BY p_partkey LIMIT 5",
    "paired_display": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, format('{}: [{:.2f}, {:.2f}]', p_partkey, p_size::DOUBLE, p_retailprice) AS left, format('{}: [{:.2f}, {:.2f}]', p_partkey, p_size::DOUBLE, p_retailprice) AS right FROM part",
    "run_command": TREE + " SELECT src, dst, round(weight, 6) AS weight FROM t",
    "split_command": "SELECT id, CAST(k.i AS INT) AS split FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) x JOIN range(7) k(i) ON x.i >= k.i * n // 7 AND x.i < (k.i + 1) * n // 7",
    "splits_all": f"WITH {EMB}, {SPLIT} SELECT id, k AS split, round(list_sum(v), 6) AS total FROM s",
}
