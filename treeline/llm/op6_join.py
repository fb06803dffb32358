"""N-gram Jaccard self-join with token-combination prefixes, and its connected groups.

A document is the set of its distinct n-word shingles; two link when their Jaccard similarity reaches the threshold.
Documents with equal sets form one class, and classes are joined:

1. One pass counts shingles, over sets that differ. Those in more than ``rare`` of them are the frequent class, all
   others the rare one. (A list of at most FREQUENT_BOUND is broadcast; what it leaves out counts as rare. The result
   doesn't depend on who is in which class.)
2. A second pass orders each set by class, rare first, and by hash. Two sets of a and b shingles that link share ``need``
   of them, so the first shingle that they share is among the first a - need + 1 of the one and b - need + 1 of the other.
   If it is rare, both index it singly. If it is frequent, all that they share is, and the first r + G + 1 - need of the r
   frequent shingles of either hold G + 1 in common. These are dealt to G groups by hash; two shared ones meet in one
   group, so only pairs within a group are indexed. With G near a - need, a set has some 3 (a - need) keys at most.
   G depends on the size of the larger set; a set near a step of G has keys for both. Each set also gives parity bits,
   four to eight a shingle, so that few pairs pass that don't link.
3. Keys that lead to the same list of sets count once. Lists of up to SHORT classes give all their pairs. Longer lists are
   divided by set size, into bands that overlap; those still longer give the pairs of each member and six pivots. The first
   pivot's pairs come first, and of all others only those count whose sets these have not connected. Pairs must pass the length bound and the parity bound (the bits in which two sets differ are at most the shingles in
   which they differ) before the sets themselves are compared.
4. Of a long list whose members these links did not all bring together, those outside of its largest component meet all
   members of other components, parity bits only, in blocks of BLOCK by BLOCK. Of the pairs that pass, each member's likeliest
   one with each component has its sets compared first; where such a pair doesn't link, all that pass are. So no list is skipped or cut, no group is held in one task, and links inside what is already connected
   aren't looked at.
5. Components of the links by star contraction.

Sets are compared by 64-bit hashes of their shingles. They are never stored: a comparison reads the texts of the
documents that it needs again, so ``docs`` should be a table, not a long plan.

Defined results for odd input: null text and text without a word give an empty set, linked with nothing; fewer words
than n make one shingle; repeated rows are documents of one class; a null doc_id takes part, and its component has the
least id that is not null; ties of shingles, sizes and pivots are broken by hash and change the work only; very long texts are
read whole, 8 bytes a shingle in one task at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm import words
from treeline.llm.components import components, merged
from treeline.session import counted, release, written

NAME = "op6_jaccard_join"
RARE = 64
FREQUENT_BOUND = 1_000_000  # shingles, 8 bytes each
SHORT = 8
BLOCK = 2048
LEAST_BITS = 512  # parity bits of a set
PIVOTS = (0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x369DEA0F31A53F85, 0x7FB5D329728EA185)
SLOTS = 1 << 20
HELD = 2_000_000  # shingles that are counted together


def shingle_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of a text, its sorted distinct shingle hashes)."""
    for b in words.blocks(texts):
        made, at = words.joined(b.value, b.word_at, tuple(range(1, n)), n) if n > 1 else (words.mix(b.value), np.arange(len(b.value)))
        owner = b.owner()[at]
        parts = np.split(made, np.searchsorted(owner, np.arange(1, b.count)))
        for k, part in enumerate(parts):
            if not len(part) and b.word_at[k + 1] > b.word_at[k]:  # fewer than n words: all of them as one
                few = np.full(1, n, np.uint64)
                for x in b.value[b.word_at[k] : b.word_at[k + 1]]:
                    few = words.mix(few + x + np.uint64(0x51))
                part = few
            yield b.first + k, np.unique(part)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def counter(n: int):
    """Shingles that occur in at least two different sets of a stretch of a partition, with the number of these sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.zeros(HELD, np.uint64), 0
        seen: set[int] = set()

        def counts(x: np.ndarray) -> pa.RecordBatch:
            x.sort()
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            times = np.diff(np.append(first, len(x)))
            some = times > 1
            return pa.RecordBatch.from_arrays([pa.array(x[first[some]].view(np.int64)), pa.array(times[some])], names=["shingle", "times"])

        for part in parts:
            for _, s in shingle_sets(part.column("text").to_pylist(), n):
                cls = class_of(s)
                if cls in seen:
                    continue
                if size + len(s) > HELD and size:
                    yield counts(held[:size])
                    size = 0
                    seen.clear()
                seen.add(cls)
                if len(s) <= HELD:  # a longer text has no stretch to share
                    held[size : size + len(s)] = s
                    size += len(s)
        if size:
            yield counts(held[:size])

    return run


def needed(n: int, percent: int) -> int:
    """How many shingles a set of n shares at least with one that it links to."""
    return -(-percent * n // 100)


def groups_of(n: int, percent: int) -> int:
    """Into how many groups frequent shingles are dealt where n is the size of the larger set; 0: they are indexed singly."""
    need = needed(n, percent)
    most = min(max(1, n - need), need - 1)
    return 1 << (most.bit_length() - 1) if most > 0 else 0


def pairs_within(s: np.ndarray, groups: int) -> np.ndarray:
    """Keys of the pairs of shingles that are dealt to one group."""
    group = (words.mix(s ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)) & np.uint64(groups - 1)
    order = np.argsort(group, kind="stable")
    s, group = s[order], group[order]
    salt, out = words.mix(np.full(1, groups, np.uint64)), [np.zeros(0, np.uint64)]
    for lag in range(1, len(s)):
        at = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(at):
            break
        out.append(words.mix(words.mix(s[at] + salt) + s[at + lag]))
    return np.concatenate(out)


def keys_of(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set: rare shingles of its prefix, and pairs of frequent ones. s, frequent: sorted."""
    n = len(s)
    need = needed(n, percent)
    if n * 100 < percent * (n + 1):  # no other set can link: one more or one less is too far
        return np.zeros(0, np.uint64)
    often = np.zeros(n, bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    rare, late = s[~often], s[often]
    keys = [rare[: n - need + 1]]
    if len(rare) <= n - need:  # else the frequent ones alone are too few for a link
        groups, most = groups_of(n, percent), groups_of(100 * n // percent, percent)
        while True:
            first = late[: len(late) - need + groups + 1]
            keys.append(pairs_within(first, groups) if groups else first)
            if groups >= most:
                break
            groups = max(1, groups * 2)
    return np.concatenate(keys)


def spread_of(percent: int) -> int:
    """Parity bits a shingle: the closer sets must be to link, the fewer bits tell others apart."""
    return 1 if percent >= 90 else 4


def parity(s: np.ndarray, spread: int = 4) -> bytes:
    """For each of ``spread`` times as many slots as the set has shingles, rounded up to a power of two, whether it has an odd number of them."""
    slots = max(LEAST_BITS, spread << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The same parity bits with fewer slots: slots that become one add up."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])
AT_ONCE = 500_000  # keys in a batch


def indexer(shared, n: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for part in parts:
            ids, hashes, texts = part.column("doc_id"), part.column("text_hash"), part.column("text").to_pylist()
            out: dict[str, list] = {c: [] for c in ("n", "cls", "keys", "bits")}
            first = size = 0

            def batch(stop: int) -> pa.RecordBatch:
                made = pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, stop - first), "text_hash": hashes.slice(first, stop - first)} | out, schema=SETS)  # noqa: B023
                for x in out.values():  # noqa: B023
                    x.clear()
                return made

            for k, s in shingle_sets(texts, n):
                keys = keys_of(s, frequent, percent)
                linked = len(keys) > 0
                out["n"].append(len(s))
                out["cls"].append(class_of(s) if len(s) else None)
                out["keys"].append(keys.view(np.int64) if linked else None)
                out["bits"].append(parity(s, spread_of(percent)) if linked else None)
                size += len(keys)
                if size > AT_ONCE:
                    yield batch(k + 1)
                    first, size = k + 1, 0
            if first < len(texts):
                yield batch(len(texts))

    return run


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, n_a, n_b), n_ the lengths, those that these and the parity bits allow."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y, n, m in zip(*(part.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")), strict=True):
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                # 100 * both >= percent * union and differ <= union - both
                good.append(differ * (100 + percent) <= (n + m) * (100 - percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in ("a", "b", "n_a", "n_b")], names=["a", "b", "n_a", "n_b"])

    bits = lambda x: reps.select(F.col("cls").alias(x), F.col("bits").alias(f"bits_{x}"))
    near = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return near.join(bits("a"), "a").join(bits("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, n_a long, n_b long")


def comparer(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y, n, m in zip(part.column("set_a"), part.column("set_b"), part.column("n_a").to_pylist(), part.column("n_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
                good.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def setter(n: int):
    """The sets themselves, as bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [s.tobytes() for _, s in shingle_sets(part.column("text").to_pylist(), n)]
            yield part.drop_columns(["text"]).append_column("s", pa.array(made, pa.binary()))

    return run


def compared(pairs: DataFrame, rows: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs(a, b, n_a, n_b), each once, those whose sets link. rows: doc_id, text, text_hash."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    owners = wanted.join(reps.select("cls", "doc_id", "text_hash"), "cls")
    # At most SLOTS rows: spares the shuffle most sets that no pair needs, as long as the pairs are few.
    slots = owners.select(F.pmod("text_hash", F.lit(SLOTS)).alias("slot")).distinct()
    few = rows.join(F.broadcast(slots), F.pmod("text_hash", F.lit(SLOTS)) == F.col("slot"), "left_semi")
    s, o = few.select("doc_id", "text_hash", "text").mapInArrow(setter(n), "doc_id long, text_hash long, s binary").alias("s"), owners.alias("o")
    blobs = s.join(o, F.expr("s.text_hash = o.text_hash AND s.doc_id <=> o.doc_id")).select("o.cls", "s.s").dropDuplicates(["cls"])  # one of rows that are equal
    side = lambda x: blobs.select(F.col("cls").alias(x), F.col("s").alias(f"set_{x}"))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(comparer(percent), "a long, b long"), "links")


def screen(percent: int, best: bool):
    """Pairs of a group (key, i, j), of its left rows and its others, whose labels differ and that lengths and parity bits allow.

    ``best``: of the pairs that a left row has with the members of one label, the one whose bits differ least.
    """

    def run(table: pa.Table) -> pa.Table:
        cls, label, n = (table.column(c).to_numpy() for c in ("cls", "label", "n"))
        packed = table.column("bits").to_pylist()
        size = min(map(len, packed))
        bits = np.stack([folded(x, size) for x in packed])
        on_left = table.column("left").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(0, len(left), 64):
            x = left[k : k + 64]
            differ = np.zeros((len(x), len(right)), np.int64)
            for w in range(bits.shape[1]):
                differ += np.bitwise_count(bits[x, None, w] ^ bits[None, right, w])
            total = n[x, None] + n[None, right]
            ok = (differ * (100 + percent) <= total * (100 - percent)) & (label[x, None] != label[None, right])
            ok &= np.minimum(n[x, None], n[None, right]) * 100 >= np.maximum(n[x, None], n[None, right]) * percent
            p, q = np.nonzero(ok)
            if best and len(p):
                by = np.lexsort((differ[p, q], label[right[q]], p))
                p, q = p[by], q[by]
                first = np.concatenate([[True], (p[1:] != p[:-1]) | (label[right[q[1:]]] != label[right[q[:-1]]])])
                p, q = p[first], q[first]
            p, q = x[p], right[q]
            p, q = np.where(cls[p] < cls[q], p, q), np.where(cls[p] < cls[q], q, p)
            found.append((cls[p], cls[q], n[p], n[q]))
        pairs = np.unique(np.concatenate([np.stack(z, 1) for z in found]), axis=0) if found else np.zeros((0, 4), np.int64)
        return pa.table({"key": np.full(len(pairs), table.column("key")[0].as_py(), np.int64)} | {c: pa.array(pairs[:, k], pa.int64()) for k, c in enumerate(("a", "b", "n_a", "n_b"))})

    return run


def screened(known: DataFrame, reps: DataFrame, percent: int, best: bool) -> DataFrame:
    """known(key, cls, label): members of lists -> (key, a, b, n_a, n_b): of the members outside of a list's most frequent label, the pairs
    with members of other labels that may link. They meet in blocks of BLOCK by BLOCK."""
    by_label = known.groupBy("key", "label").agg(F.count("*").alias("k"))
    tops = by_label.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("size")).where("most < size")
    part = known.join(tops, "key").join(reps.select("cls", "n", "bits"), "cls").withColumn("rest", F.col("label") != F.col("top"))
    lefts, rights = F.ceil((F.col("size") - F.col("most")) / BLOCK), F.ceil(F.col("size") / BLOCK)
    upto = lambda x: F.sequence(F.lit(0).cast("long"), x - 1)
    # Each row of the rest once on the left of every block of members, each member once on the right of every block of the rest.
    part = part.select("key", "cls", "label", "n", "bits", "rest", F.pmod(F.xxhash64("cls"), lefts).alias("of_left"), F.pmod(F.xxhash64("cls"), rights).alias("of_right"), lefts.alias("lefts"), rights.alias("rights"))
    left = part.where("rest").select("key", F.col("of_left").alias("i"), F.explode(upto(F.col("rights"))).alias("j"), "cls", "label", "n", "bits", F.lit(True).alias("left"))
    right = part.select("key", F.explode(upto(F.col("lefts"))).alias("i"), F.col("of_right").alias("j"), "cls", "label", "n", "bits", F.lit(False).alias("left"))
    return left.unionByName(right).groupBy("key", "i", "j").applyInArrow(screen(percent, best), "key long, a long, b long, n_a long, n_b long")


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of the lists of at most SHORT classes, as far as their lengths allow."""
    short = lists.where(F.col("size") <= SHORT)
    a, b = (short.select("key", F.col("cls").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "key").where("a < b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "n_a", "n_b")


def linked(docs: DataFrame, n: int = 3, percent: int = 90, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (sets(doc_id, text_hash, n, cls) with one row per document, (v, root) of the classes that link)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("text_hash"))
    counts = rows.select("text").mapInArrow(counter(n), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") > rare)
    frequent = counts.orderBy(F.desc("times"), "shingle").limit(FREQUENT_BOUND).select("shingle").toArrow().column(0).to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))
    made = written(rows.mapInArrow(indexer(shared, n, percent), "doc_id long, text_hash long, n long, cls long, keys array<long>, bits binary"), "sets")
    sets = written(made.select("doc_id", "text_hash", "n", "cls"), "sets")
    reps = written(made.where("keys IS NOT NULL").drop("keys").dropDuplicates(["cls"]), "classes")
    posted = made.select("cls", "n", F.explode("keys").alias("key"))
    several = posted.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    live = written(posted.join(several, "key").distinct(), "lists")
    release(made, collect=True)
    # Of keys with the same list, the least.
    alike = live.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    lists = written(live.join(alike.select("key", "size"), "key"), "lists")
    release(live, collect=True)
    # Long lists fall apart by size: two sets that link lie in the same band or in neighbouring ones.
    band = F.floor(F.log(F.col("n")) / (np.log(100 / percent) * 1.0001))
    banded = lists.where(F.col("size") > SHORT).select("cls", "n", F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))).alias("key"))
    pivots = [F.min(F.col("cls").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"p{k}") for k, x in enumerate(PIVOTS)]
    sizes = banded.groupBy("key").agg(F.count("*").alias("size"), *pivots).where("size > 1")
    banded = written(banded.join(sizes, "key").select("key", "cls", "n", "size", F.array(*[f"p{k}" for k in range(len(PIVOTS))]).alias("pivots")), "lists")
    long = banded.where(F.col("size") > SHORT)
    lengths = reps.select(F.col("cls").alias("p"), F.col("n").alias("n_p"))

    def star(pivots):
        """Each member with these pivots of its list."""
        met = long.select("cls", "n", F.explode(F.array_distinct(pivots)).alias("p")).where("cls <> p").distinct().join(lengths, "p")
        order = lambda x, y: (F.when(F.col("cls") < F.col("p"), F.col(x)).otherwise(F.col(y)), F.when(F.col("cls") < F.col("p"), F.col(y)).otherwise(F.col(x)))
        return met.select(*(c.alias(x) for c, x in zip(order("cls", "p") + order("n", "n_p"), ("a", "b", "n_a", "n_b"), strict=True)))

    # The first pivot of the long lists connects most of a large group; other pairs count only where that has left two apart.
    near = written(likely(star(F.slice("pivots", 1, 1)).distinct(), reps, percent), "pairs")
    first = compared(near, rows, reps, n, percent)
    release(near, collect=True)
    sides = written(components(first), "sides")
    pairs = short_pairs(lists, percent).unionByName(short_pairs(banded, percent)).unionByName(star(F.slice("pivots", 2, len(PIVOTS)))).distinct()
    for x in "ab":
        pairs = pairs.join(sides.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    near, many = counted(likely(pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "n_a", "n_b"), reps, percent), "pairs")
    release(lists, collect=True)
    if many:  # without pairs, here and below, there is nothing to plan or to start tasks for
        sides = merged(sides, compared(near, rows, reps, n, percent))
    release(near, collect=True)
    label = sides.select(F.col("v").alias("cls"), F.col("root").alias("label"))
    known = written(long.select("key", "cls").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    release(banded, collect=True)
    # First each member's likeliest pair with a component. Only where one of these doesn't link are all pairs looked at.
    met, many = counted(screened(known, reps, percent, True), "met")
    if not many:
        return sets, sides
    sides = merged(sides, compared(written(met.drop("key").distinct(), "pairs"), rows, reps, n, percent))
    for x in "ab":
        met = met.join(sides.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    still = met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("key").distinct()
    known = known.join(still, "key", "left_semi").select("key", "cls").join(sides.select(F.col("v").alias("cls"), F.col("root").alias("label")), "cls", "left")
    known, many = counted(known.withColumn("label", F.coalesce("label", "cls")), "labelled")
    if not many:
        return sets, sides
    rest, many = counted(screened(known, reps, percent, False).drop("key").distinct(), "pairs")
    release(known, collect=True)
    return sets, merged(sides, compared(rest, rows, reps, n, percent)) if many else sides


def groups(docs: DataFrame, n: int = 3, percent: int = 90, rare: int = RARE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    sets, roots = linked(docs, n, percent, rare)
    s = sets.select("doc_id", "n", "cls").join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = s.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return s.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked documents: the one of least (doc_id, hash of the text). All columns stay.

    Rows without a word stay all. A null doc_id comes before others.
    """
    sets, roots = linked(docs, n, percent)
    roots = roots.withColumnRenamed("v", "cls")
    none = F.lit(-(1 << 63))
    s = sets.select("doc_id", "cls", "text_hash").join(roots, "cls", "left").select(F.coalesce("root", "cls").alias("root"), F.coalesce("doc_id", none).alias("k_id"), F.col("text_hash").alias("k_text"))
    first = s.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("k_id", "k_text")).alias("k")).select("k.*", F.lit(True).alias("one"))
    bare = s.where("root IS NULL").select("k_id", "k_text", F.lit(False).alias("one")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("k_id"), F.xxhash64("doc_id", "text").alias("k_text"))
    again = F.row_number().over(W.partitionBy("k_id", "k_text").orderBy("one"))  # rows of one key have equal ids and texts
    return rows.join(first.unionByName(bare), ["k_id", "k_text"]).withColumn("again", again).where("again = 1 OR NOT one").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs by shared shingles: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d),
e AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 90 * (n + m - k)),
y AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(r, o) AS (SELECT r, r FROM s UNION SELECT t.r, y.b FROM t JOIN y ON t.o = y.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT t.r, min(s.doc_id) AS component_id FROM t JOIN s ON t.o = s.r GROUP BY t.r) c ON s.r = c.r
"""
