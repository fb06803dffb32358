"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE words, in blocks of BLOCK passages. One pass over all documents
counts in how many each benchmark word occurs, and draws FIT_WINDOWS windows of text by a hash. For each block, the TF-IDF
rows of its passages and of these windows (at CORPUS times their length, over the words of the block) are a table, and a
randomised SVD, computed from sums over the table's partitions, gives a latent space of half as many dimensions as the
block has passages, RANK at most. Every document is read in windows of WINDOW words, half of each shared with the next. A
window's cosine with a passage is the product of its latent vector and the passage's, of length 1, over the window's
whole TF-IDF norm, words that no item has included. Windows that reach COSINE are candidates: the stated set of items
meets all windows in matrix products.

A benchmark of more than SHARD_WORDS words is dealt to shards by a hash, with a model and a pass of its own each, so what
is collected and broadcast is bounded.

Around a candidate, words are aligned with the whole item by a longest common subsequence. It leaks where the
subsequence has at least COPY of the item's words; or where it has at least PARAPHRASE of them and the answer, the last
ANSWER words of the item, is there too, as far as ANSWERED of it. An item of more than PASSAGE words also leaks where PART
of one of its passages of PASSAGE words is there, or any RUN words of it in a row.

Words that more than COMMON of all documents have don't count, but each passage keeps at least KEEP of its rarest words.
No word weighs more than one that a single of LEVEL documents has, so cosines depend on the words' shares of the documents
and not on how many documents there are.

Defined results for odd input: null texts have no window; null and wordless items match nothing; equal rows of one
doc_id give one row; ids of several items with one text are all reported; of passages that tie all are looked at; very long
texts are read whole, in windows of which each is looked at by itself; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import words
from treeline.session import written

NAME = "op10_decontaminate"
PASSAGE = 64
WINDOW = 64
BLOCK = 256  # passages of a latent space
RANK = 128
FIT_WINDOWS = 4096
CORPUS = 0.3
SHARD_WORDS = 1_000_000
COSINE = 0.1
COPY = 0.75
PART = 0.8
RUN = 48
LEAST_OF_RUN = 40  # words of RUN in a row that lie in one passage at least, as passages start half a passage apart
PARAPHRASE = 0.55
ANSWER = 6
ANSWERED = 0.5
COMMON = 0.1
KEEP = 8
LEVEL = 10_000
STEPS = 2  # power iterations
CELL = 256  # terms that are summed together
AT_ONCE = 1024  # windows


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    mask: dict[int, int]
    answer: dict[int, int]
    n_answer: int
    passages: list[dict[int, int]]  # of an item of more than PASSAGE words


def positions(w: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(w.tolist()):
        out[x] = out.get(x, 0) | 1 << k
    return out


def common_length(mask: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a text and the n words whose places mask gives: one step a word."""
    full = (1 << n) - 1
    v = full
    for x in text:
        m = mask.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def in_a_row(a: np.ndarray, b: np.ndarray, n: int = RUN) -> bool:
    """Whether n words in a row of a are in b."""
    rows = [set(words.joined(x.astype(np.uint64), np.array([0, len(x)]), tuple(range(1, n)), n)[0].tolist()) for x in (a, b)]
    return not rows[0].isdisjoint(rows[1])


def word_blocks(texts: list[str | None]) -> Iterator[words.Block]:
    return words.blocks([t.lower() if t else t for t in texts], words.NOT_ALNUM)


def items_of(rows: list[tuple[int, str | None]]) -> list[Item]:
    out = []
    for b in word_blocks([r[1] for r in rows]):
        for k in range(b.count):
            w = b.value[b.word_at[k] : b.word_at[k + 1]]
            if len(w):
                tail = w[-min(ANSWER, len(w)) :]
                whole = [positions(w[a : a + PASSAGE]) for a in np.minimum(starts(len(w)), len(w) - PASSAGE)] if len(w) > PASSAGE else []
                out.append(Item(rows[b.first + k][0], w, positions(w), positions(tail), len(tail), whole))
    return out


def starts(n: int) -> list[int]:
    """Where the passages of an item of n words start."""
    return [a for a in range(0, max(1, n - PASSAGE // 2), PASSAGE // 2) if a == 0 or n > PASSAGE]


COUNTED = pa.schema([("term", pa.int64()), ("docs", pa.int64()), ("h", pa.int64()), ("window", pa.list_(pa.int32()))])


def frequency_counter(shared, share: float):
    """Document frequencies of the benchmark's words, for each partition (term -1: documents), and windows of ``share`` of
    the texts that have a word: the benchmark's words in a stretch of WINDOW words, both chosen by the words' hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, docs = np.zeros(len(terms), np.int64), 0
        for part in parts:
            drawn: list[tuple[int, list[int]]] = []
            for b in word_blocks(part.column("text").to_pylist()):
                at = lookup(terms, b.value)
                hit = at >= 0
                key = np.unique(b.owner()[hit] * len(terms) + at[hit])
                total += np.bincount(key % len(terms), minlength=len(terms)) if len(terms) else 0
                docs += b.count
                some = np.flatnonzero(np.diff(b.word_at))
                h = words.mix(np.add.reduceat(b.value, b.word_at[some])) if len(some) else np.zeros(0, np.uint64)
                for k in np.flatnonzero((h >> np.uint64(34)) < np.uint64(int(share * (1 << 30)))):
                    first, stop = b.word_at[some[k]], b.word_at[some[k] + 1]
                    first += int(h[k] % np.uint64(max(1, -(-(stop - first) * 2 // WINDOW) - 1))) * (WINDOW // 2)
                    window = at[first : min(first + WINDOW, stop)]
                    drawn.append((int(h[k].view(np.int64)), window[window >= 0].tolist()))
            if drawn:
                n = len(drawn)
                yield pa.RecordBatch.from_pydict({"term": [None] * n, "docs": [None] * n, "h": [x[0] for x in drawn], "window": [x[1] for x in drawn]}, schema=COUNTED)
        some = np.flatnonzero(total)
        n = len(some) + 1
        yield pa.RecordBatch.from_pydict({"term": np.append(some, -1), "docs": np.append(total[some], docs), "h": [None] * n, "window": [None] * n}, schema=COUNTED)

    return run


def lookup(terms: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted terms, or -1."""
    if not len(terms):
        return np.full(len(value), -1)
    slot = np.zeros(1 << 20, bool)
    slot[terms >> np.uint64(44)] = True
    out = np.full(len(value), -1)
    maybe = np.flatnonzero(slot[value >> np.uint64(44)])
    at = np.minimum(np.searchsorted(terms, value[maybe]), len(terms) - 1)
    same = terms[at] == value[maybe]
    out[maybe[same]] = at[same]
    return out


def randomized_svd(rows: DataFrame, n_terms: int, rank: int, steps: int = STEPS) -> np.ndarray:
    """The first ``rank`` right singular vectors (term x rank) of rows(terms array<int>, weights array<double>).

    Each step sums A'(A Q) over the partitions of A, in cells of terms, and orthonormalises it on the driver; what comes
    to the driver is term x rank, bounded by the benchmark's words, never by the rows.
    """
    spark = rows.sparkSession
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((n_terms, min(rank, n_terms))))

    def times(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def part_sum(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            out, any_row = np.zeros_like(q), False
            for part in parts:
                for t, w in zip(part.column("terms").to_pylist(), part.column("weights").to_pylist(), strict=True):
                    t, w = np.array(t, np.int64), np.array(w)
                    out[t] += w[:, None] * (w @ q[t])[None]
                    any_row = True
            if any_row:
                cells = range(0, len(q), CELL)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([out[c : c + CELL].tobytes() for c in cells], pa.binary())], names=["cell", "block"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in table.column("block").to_pylist())
            return pa.table({"cell": table.column("cell")[:1], "block": pa.array([total.tobytes()], pa.binary())})

        got = rows.mapInArrow(part_sum, "cell long, block binary").groupBy("cell").applyInArrow(add, "cell long, block binary").collect()
        y = np.zeros_like(q)
        for r in got:
            y[r["cell"] : r["cell"] + CELL] = np.frombuffer(r["block"], np.float64).reshape(-1, q.shape[1])
        return y

    for _ in range(steps):
        q, _ = np.linalg.qr(times(q))
    middle = q.T @ times(q)
    value, vector = np.linalg.eigh((middle + middle.T) / 2)
    order = np.argsort(-value)
    return q @ vector[:, order[value[order] > 1e-9 * max(value.max(), 1e-30)]]


@dataclass
class Space:
    """The latent space of a block of passages."""

    place: np.ndarray  # of each term among the block's, or -1
    words: np.ndarray  # term of the block x dimension, with the terms' weights
    passages: np.ndarray  # passage x dimension, of length 1
    item: np.ndarray  # of each passage, into the items


@dataclass
class Model:
    items: list[Item]
    terms: np.ndarray
    weight: np.ndarray  # of each term; 0 if common
    other: float  # of a word that no item has
    spaces: list[Space]


class Shards:
    """The models of a benchmark, one for each shard of it. Each is fitted when it is its turn, so the driver holds one at a time."""

    def __init__(self, size: int, fit: Callable[[int], Model]) -> None:
        self.size, self.fit, self.only = size, fit, None

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[Model]:
        for k in range(self.size):
            if self.size == 1:
                self.only = self.only or self.fit(k)
                yield self.only
            else:
                yield self.fit(k)


def train(docs: DataFrame, benchmark: DataFrame) -> Shards:
    """docs(text), benchmark(item_id, text) -> a model for each shard of the benchmark, which is the stated query set."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    n = docs.select("text").count()
    share = min(1.0, (2 * FIT_WINDOWS + 100) / max(n, 1))

    def fit(k: int) -> Model:
        items = items_of([(r[0], r[1]) for r in rows.where(shard == k).orderBy("item_id", "text").collect()])
        terms = np.unique(np.concatenate([x.words for x in items])) if items else np.zeros(0, np.uint64)
        shared = spark.sparkContext.broadcast(terms)
        counted = written(docs.select("text").mapInArrow(frequency_counter(shared, share), "term long, docs long, h long, window array<int>"), "counts")
        df = np.zeros(len(terms) + 1)
        for r in counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
            df[r["term"]] = r["docs"]  # -1: all documents
        drawn = counted.where("h IS NOT NULL").dropDuplicates(["h"]).orderBy("h").limit(FIT_WINDOWS).select("window")
        return fitted(spark, items, terms, df[:-1], df[-1], drawn)

    return Shards(shards, fit)


def fitted(spark: SparkSession, items: list[Item], terms: np.ndarray, df: np.ndarray, n: float, drawn: DataFrame | None = None) -> Model:
    """df: how many of the n documents have each term. drawn(window): the benchmark's words in windows of the documents."""
    most = float(np.log(1 + min(n, LEVEL)))
    idf = np.minimum(np.log((1 + n) / (1 + df)), most) + 0.1
    spans = [(k, a) for k, x in enumerate(items) for a in starts(len(x.words))]
    kept, rows = df <= COMMON * n, []
    for k, a in spans:
        w, times = np.unique(lookup(terms, items[k].words[a : a + PASSAGE]), return_counts=True)
        rows.append((w, times))
        kept[w[np.argsort(df[w], kind="stable")[:KEEP]]] = True
    weight = np.where(kept, idf, 0)
    spaces = []
    for first in range(0, len(spans), BLOCK):
        block = range(first, min(first + BLOCK, len(spans)))
        own = np.unique(np.concatenate([rows[k][0] for k in block]))
        own = own[weight[own] > 0]
        place = np.full(len(terms), -1, np.int32)
        place[own] = np.arange(len(own))
        sparse = []
        for k in block:
            w, times = rows[k]
            w, x = place[w], weight[w] * times
            sparse.append((w[x > 0], x[x > 0] / max(np.linalg.norm(x), 1e-12)))
        table = spark.createDataFrame([(w.tolist(), x.tolist()) for w, x in sparse], "terms array<int>, weights array<double>")
        if drawn is not None:
            table = table.unionByName(drawn.mapInArrow(weighed(place, weight), "terms array<int>, weights array<double>"))
        v = randomized_svd(written(table, "passages"), len(own), min(RANK, -(-len(block) // 2)))
        latent = np.stack([x @ v[w] for w, x in sparse])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        spaces.append(Space(place, (weight[own, None] * v).astype(np.float32), latent.astype(np.float32), np.array([spans[k][0] for k in block])))
    return Model(items, terms, weight, 0.6 * most, spaces)


def weighed(place: np.ndarray, weight: np.ndarray):
    """Windows as rows of TF-IDF weights of length CORPUS, over the words of a block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[list[int], list[float]]] = []
            for window in part.column("window").to_pylist():
                w, times = np.unique(np.array(window, np.int64), return_counts=True)
                x = np.where(place[w] >= 0, weight[w] * times, 0)
                if x.any():
                    out.append((place[w[x > 0]].tolist(), (CORPUS * x[x > 0] / np.linalg.norm(x)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float64()))], names=["terms", "weights"])

    return run


def windows(word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and word after the last of each window of a block."""
    n, step = np.diff(word_at), WINDOW // 2
    each = np.where(n == 0, 0, np.maximum(1, -(-n // step) - 1))
    text = np.repeat(np.arange(len(n)), each)
    start = word_at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * step
    return text, start, np.minimum(start + WINDOW, word_at[text + 1])


def candidates(model: Model, b: words.Block) -> tuple[dict[tuple[int, int], list[tuple[float, int]]], np.ndarray, np.ndarray]:
    """(text of the block, item) -> (cosine, window) of each candidate; first word and word after the last of the windows."""
    at = lookup(model.terms, b.value)
    known = at >= 0
    weight = np.where(known, model.weight[at], model.other) if len(model.terms) else np.full(len(at), model.other)
    square = np.concatenate([[0], np.cumsum(weight**2)])
    used = np.flatnonzero(known & (weight > 0))
    inside = np.concatenate([[0], np.cumsum(weight[used] ** 2)])
    text, start, stop = windows(b.word_at)
    a, z = np.searchsorted(used, start), np.searchsorted(used, stop)
    norm = np.sqrt(np.maximum(square[stop] - square[start], 1e-12))
    some = inside[z] - inside[a] >= (COSINE * norm) ** 2 * 0.999  # no cosine can be larger than this share's root
    best: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for first in range(0, len(text), AT_ONCE):
        w = first + np.flatnonzero(some[first : first + AT_ONCE])
        if not len(w):
            continue
        lo, hi = a[w[0]], z[w].max()
        term = at[used[lo:hi]]
        for space in model.spaces:
            place = space.place[term]
            rows = np.where(place[:, None] >= 0, space.words[place], np.float32(0))
            running = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
            latent = ((running[z[w] - lo] - running[a[w] - lo]) / norm[w, None]).astype(np.float32)
            far = np.flatnonzero((latent**2).sum(1) >= COSINE**2 * 0.999)
            cosine = np.minimum(1, latent[far] @ space.passages.T)
            for i, j in zip(*np.nonzero(cosine >= COSINE), strict=True):
                best.setdefault((int(text[w[far[i]]]), int(space.item[j])), []).append((float(cosine[i, j]), int(w[far[i]])))
    return best, start, stop


def leaks_of(model: Model, b: words.Block) -> list[tuple[int, int, int, float, float]]:
    """(text of the block, item, words in common, share of the item, cosine) of each leak."""
    best, start, stop = candidates(model, b)
    out = []
    for (t, k), found in sorted(best.items()):
        item = model.items[k]
        n = len(item.words)
        part = None
        for cosine, w in sorted(found, reverse=True):
            region = b.value[max(b.word_at[t], start[w] - n) : min(b.word_at[t + 1], stop[w] + n)].tolist()
            both = common_length(item.mask, n, region)
            if both >= COPY * n or both >= PARAPHRASE * n and common_length(item.answer, item.n_answer, region) >= ANSWERED * item.n_answer:
                out.append((t, k, both, both / n, cosine))
                break
            if item.passages and part is None:
                near = b.value[max(b.word_at[t], start[w] - PASSAGE) : min(b.word_at[t + 1], stop[w] + PASSAGE)].tolist()
                most = max(common_length(x, PASSAGE, near) for x in item.passages)
                if most >= PART * PASSAGE or most >= LEAST_OF_RUN and in_a_row(item.words, np.array(near, np.uint64)):
                    part = (t, k, both, both / n, cosine)
        else:
            out += [part] if part else []
    return out


def leaks(docs: DataFrame, models: Shards | list[Model]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, item_id, n_common, share, cosine: one row for each document and item that it leaks."""
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_common", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())])

    def finder(shared):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for part in parts:
                ids = part.column("doc_id").to_pylist()
                out: list[tuple] = []
                for b in word_blocks(part.column("text").to_pylist()) if model.spaces else ():
                    out += [(ids[b.first + t], model.items[k].item_id, *rest) for t, k, *rest in leaks_of(model, b)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k, model in enumerate(models, 1):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        part = rows.mapInArrow(finder(shared), "doc_id long, item_id long, n_common long, share double, cosine double")
        if k < len(models):
            part = written(part, "leaks")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_common").alias("n_common"), F.max("share").alias("share"), F.max("cosine").alias("cosine"))


def clean(docs: DataFrame, models: Shards | list[Model]) -> DataFrame:
    """docs without the rows that leak an item; all columns stay."""

    def keeper(shared):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for part in parts:
                keep = np.ones(len(part), bool)
                for b in word_blocks(part.column("text").to_pylist()) if model.spaces else ():
                    keep[[b.first + x[0] for x in leaks_of(model, b)]] = False
                yield part.filter(pa.array(keep))

        return run

    for k, model in enumerate(models, 1):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        docs = docs.mapInArrow(keeper(shared), docs.schema)
        if k < len(models):
            docs = written(docs, "clean")
            shared.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, train(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
