"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are hashes of its words and their stems (the first 4 to 10 bytes), of pairs of neighbours and of pairs
with one word between (lower-cased, split at ASCII punctuation and white space). A feature that occurs twice, or four
times, also sets a second, or third, slot. FTRL-proximal keeps a rate per coordinate and sets weights within the L1
bound to exactly 0, so the model that is broadcast is the short list of other weights.

The fit takes a bounded sample of labelled rows: at most FIT_ROWS texts of at most FIT_CHARS code points. Of several
labels for one id the highest counts. Every text is scored whole.

Defined results for odd input: null and empty texts get the intercept's score; without labels every score is 0; a null
doc_id hashes as empty text, hence held out; repeated rows are scored each; of texts with one labelled id each is learnt
from; a score of exactly 0.5 predicts 1; ties in the sample go by id, label and MD5 of the text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import words
from treeline.llm.sampling import labelled_sample, remainder

NAME = "op9_toxicity"
FIT_ROWS = 8000
FIT_CHARS = 20_000
BITS = 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
STEPS = 16_000  # updates in all; small samples are gone through more often
MOST_EPOCHS = 20
STEMS = (4, 5, 6, 7, 8, 10)
#: From how many occurrences on, and what is put to the slot.
OFTEN = ((2, 0x5555), (4, 0xAAAA))


@dataclass
class Model:
    slots: np.ndarray
    values: np.ndarray
    bias: float
    none: bool = False


def features(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block: first text, number of texts, slots of its features (one an occurrence) and the text of each slot."""
    shift = np.uint64(64 - bits)
    lowered = [x.lower() if x else x for x in texts]
    for b in words.blocks(lowered, words.NOT_ALNUM):
        owner = b.owner()
        two, at = words.joined(b.value, b.word_at, (1,), 2)
        skip, far = words.joined(b.value, b.word_at, (2,), 3)
        found, of = [b.value, two, skip], [owner, owner[at], owner[far]]
        for n in STEMS:
            long = b.stop - b.start >= n
            found.append(b.head(n, long) + np.uint64(n))
            of.append(owner[long])
        yield b.first, b.count, (words.mix(np.concatenate(found)) >> shift).astype(np.int64), np.concatenate(of)


def levels(key: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct keys (text << bits | slot) of occurrences, and the slots that say a feature occurs often."""
    key, times = np.unique(key, return_counts=True)
    return np.unique(np.concatenate([key, *(key[times >= n] ^ x for n, x in OFTEN)]))


def fit(rows: list[tuple[int, int, str]], bits: int = BITS) -> Model:
    """rows: (doc_id, label, text), in the order to learn in."""
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, True)
    each: list[np.ndarray] = []
    for _, count, slots, owner in features([r[2] for r in rows], bits):
        key = levels(owner.astype(np.int64) << bits | slots, bits)
        parts = np.split(key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(1, count)))
        each += [np.append(p, 1 << bits) for p in parts]  # the last slot is the intercept
    label = np.array([float(r[1] > 0) for r in rows])
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    l1 = np.full((1 << bits) + 1, L1)
    l1[-1] = 0

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= l1[i], 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(max(1, min(MOST_EPOCHS, STEPS // len(rows)))):
        for k in order.permutation(len(rows)):
            i = each[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << bits) + 1))
    slots = np.flatnonzero(w[:-1])
    return Model(slots, w[slots], float(w[-1]))


def scorer(shared, bits: int = BITS):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = np.zeros(1 << bits, np.float64)
        weight[model.slots] = model.values
        used = weight != 0
        near = used.copy()  # whose occurrences must be counted
        for _, x in OFTEN:
            near |= used[np.arange(1 << bits) ^ x]
        for part in parts:
            texts = part.column("text").to_pylist()
            total = np.full(len(texts), model.bias)
            for first, count, slots, owner in features(texts, bits):
                hit = near[slots]
                key = levels(owner[hit].astype(np.int64) << bits | slots[hit], bits)
                total[first : first + count] += np.bincount(key >> bits, weight[key & ((1 << bits) - 1)], count)
            score = np.zeros(len(texts)) if model.none else 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, most_chars: int = FIT_CHARS) -> Model:
    """docs(doc_id, text), labels(doc_id, <label>): learns from ids whose remainder is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).where(F.col(label).isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.max(label).alias(label))
    return fit(labelled_sample(docs.select("doc_id", "text"), known, label, rows, most_chars, labels.count()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), "text")
    return rows.mapInArrow(scorer(shared), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
