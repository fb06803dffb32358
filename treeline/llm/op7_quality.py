"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on each text. Expectation-maximisation over the counts of
vote patterns of all documents estimates how often each labeller votes and errs on good and on bad texts, and the share
of good ones, without any true label; the posterior of a pattern is its soft label. Patterns are few (3 to the number of
labellers at most), so the counts are aggregated on the executors and the fit on the driver is of bounded size.

A hashed linear scorer (logistic regression with hashed words, word pairs and character shapes) is then trained on soft
labels of a bounded sample, FIT_ROWS texts of at most FIT_CHARS code points, and scores every text whole. It sees words, not the labellers' measures, and so also judges texts on which
all labellers abstain.

Defined results for odd input: null and empty texts get the vote of the length labeller alone and the scorer's
intercept; in an empty table nothing is learnt and nothing returned; repeated rows are scored each; ties in the sample
go by a hash of id and text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import words

NAME = "op7_quality"
FIT_ROWS = 3000
FIT_CHARS = 20_000
BITS = 18
EPOCHS = 12
KEEP = 0.5
LABELLERS = ("length", "word_length", "symbols", "capitals", "sentences", "repeats", "variety", "ends", "columns")


def votes(texts: list[str | None]) -> np.ndarray:
    """text x labeller: 1 good, -1 bad, 0 no opinion."""
    out = np.zeros((len(texts), len(LABELLERS)), np.int8)

    def say(k: int, rows: slice, good: np.ndarray, bad: np.ndarray) -> None:
        out[rows, k] = np.where(bad, -1, np.where(good, 1, 0))

    for b in words.blocks(texts, words.SPACE, words.AS_IS):
        rows = slice(b.first, b.first + b.count)
        a, z = b.text_at[:-1], b.text_at[1:] - 1

        def share(chars: str | np.ndarray) -> np.ndarray:
            flag = chars if isinstance(chars, np.ndarray) else np.isin(b.raw, np.frombuffer(chars.encode(), np.uint8))  # noqa: B023
            total = np.concatenate([[0], np.cumsum(flag)])
            return total[z] - total[a]  # noqa: B023

        size = np.maximum(z - a, 1)
        n = np.diff(b.word_at)
        some, none = n >= 5, np.zeros(b.count, bool)
        letters = share(((b.raw | 32) >= 97) & ((b.raw | 32) <= 122) | (b.raw >= 128))
        upper = share((b.raw >= 65) & (b.raw <= 90))
        symbols = share("#$%&*|<>{}[]\\^~=@_+!")
        stops = share(".!?")
        mean = letters / np.maximum(n, 1)
        owner = b.owner()
        same = np.concatenate([b.value[1:] == b.value[:-1], [False]]) if len(b.value) else np.zeros(0, bool)
        if len(same):
            same[b.word_at[1:][b.word_at[1:] > 0] - 1] = False
        twice = np.bincount(owner[same], minlength=b.count)
        three, at = words.joined(b.value, b.word_at, (1, 2), 3)
        whose = owner[at]
        fresh = np.bincount(whose[np.unique(words.mix(three + whose.astype(np.uint64)), return_index=True)[1]], minlength=b.count)
        grams = np.bincount(whose, minlength=b.count)
        last = b.raw[np.maximum(z - 1, a)]
        say(0, rows, (n >= 40) & (n <= 20_000), n < 12)
        say(1, rows, some & (mean >= 3) & (mean <= 9), some & ((mean < 2.2) | (mean > 14)))
        say(2, rows, none, symbols > 0.05 * size)
        say(3, rows, none, some & (upper > 0.5 * letters))
        say(4, rows, none, (n >= 40) & ((stops * 120 < n) | (stops > n)))
        say(5, rows, none, some & (twice * 12 > n))
        say(6, rows, (grams >= 30) & (fresh * 100 >= 95 * grams), (grams >= 10) & (fresh * 10 < grams * 7))
        say(7, rows, some & np.isin(last, np.frombuffer(b'.!?"', np.uint8)), none)
        say(8, rows, none, some & (share("|\t") * 8 > n))
    return out


def packed(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def unpacked(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    prior: float
    rate: np.ndarray  # class (bad, good) x labeller x vote (-1, 0, 1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good, for rows of votes."""
        log = np.log(self.rate)
        both = np.log([1 - self.prior, self.prior])[None] + np.stack([sum(log[c, k, v[:, k] + 1] for k in range(v.shape[1])) for c in (0, 1)], 1)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))


#: Where EM starts, and what it is held to with the weight of a share HOLD of the documents: votes (-1, 0, 1) on bad and
#: on good texts. Each kind of bad text moves few labellers, so their votes overlap too little to be left to the counts.
START = np.array([[0.25, 0.4, 0.35], [0.01, 0.39, 0.6]])
PRIOR = 0.8
HOLD = 0.05


def label_model(v: np.ndarray, count: np.ndarray, rounds: int = 300) -> LabelModel:
    """EM over vote patterns v with their counts. A vote that a labeller never casts has no say."""
    m = v.shape[1]
    cast = np.array([[(v[:, k] == x).any() for x in (-1, 0, 1)] for k in range(m)])
    start = np.where(cast, START[:, None], 1e-9)
    start /= start.sum(2, keepdims=True)
    hold = HOLD * count.sum() + 1
    model = LabelModel(PRIOR, start)
    for _ in range(rounds):
        good = model.posterior(v)
        weight = np.stack([count * (1 - good), count * good])
        total = weight.sum(1)
        seen = np.stack([[[weight[c, v[:, k] == x].sum() for x in (-1, 0, 1)] for k in range(m)] for c in (0, 1)])
        rate = (seen + hold * start) / (total[:, None, None] + hold)
        new = LabelModel(float((total[1] + hold * PRIOR) / (total.sum() + hold)), rate)
        done = abs(new.prior - model.prior) < 1e-9 and np.abs(new.rate - model.rate).max() < 1e-7
        model = new
        if done:
            break
    return model


@dataclass
class Scorer:
    weight: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1, np.float32))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, count, slots, owner, size in features(texts):
            out[first : first + count] = np.bincount(owner, self.weight[slots], count) / size + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: first text, count, slots, text of each slot, and what a text's sum is divided by."""
    shift = np.uint64(64 - BITS)
    for b in words.blocks(texts, words.SPACE, words.AS_IS):
        owner = b.owner()
        two, at = words.joined(b.value, b.word_at, (1,), 2)
        # The shape of a word: its last byte's class, whether it starts or continues in capitals, its length.
        last, first, second = (b.raw[x].astype(np.int64) for x in (b.stop - 1, b.start, np.minimum(b.start + 1, b.stop - 1)))
        kind = lambda x: np.where(x >= 128, 3, np.where((x >= 97) & (x <= 122), 0, np.where((x >= 65) & (x <= 90), 1, np.where((x >= 48) & (x <= 57), 2, 4 + x % 16))))
        shape = words.mix((((kind(last) * 32 + kind(first)) * 32 + kind(second)) * 16 + np.minimum(b.stop - b.start, 15)).astype(np.uint64) + np.uint64(1 << 32))
        same = np.concatenate([[False], (b.value[1:] == b.value[:-1]) & (owner[1:] == owner[:-1])]) if len(b.value) else np.zeros(0, bool)
        again = np.full(int(same.sum()), words.mix(np.array([77], np.uint64))[0])
        found = np.concatenate([b.value, two, shape, again]) >> shift
        of = np.concatenate([owner, owner[at], owner, owner[same]])
        yield b.first, b.count, found.astype(np.int64), of, np.sqrt(np.maximum(np.bincount(of, minlength=b.count), 1))


def fit(texts: list[str], good: np.ndarray) -> Scorer:
    """AdaGrad on the log loss against soft labels, one text at a time."""
    scorer = Scorer()
    if not texts:
        return scorer
    each = []
    for _, count, slots, owner, size in features(texts):
        order = np.argsort(owner, kind="stable")
        for k, part in enumerate(np.split(slots[order], np.searchsorted(owner[order], np.arange(1, count)))):
            slot, times = np.unique(part, return_counts=True)
            each.append((np.append(slot, 1 << BITS), np.append(times / size[k], 1.0)))
    w, total = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(each)):
            i, x = each[k]
            g = (1 / (1 + np.exp(-np.clip((w[i] * x).sum(), -35, 35))) - good[k]) * x + 1e-5 * w[i]
            total[i] += g * g
            w[i] -= 0.15 * g / np.sqrt(total[i])
    scorer.weight = w.astype(np.float32)
    return scorer


def voter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(votes(part.column("text").to_pylist())))], names=["doc_id", "pattern"])


def train(docs: DataFrame, rows: int = FIT_ROWS, most_chars: int = FIT_CHARS) -> tuple[LabelModel, Scorer]:
    """docs(doc_id, text): the label model from all documents, the scorer from a bounded sample of them."""
    ballots = docs.select("doc_id", "text").mapInArrow(voter, "doc_id long, pattern long")
    found = ballots.groupBy("pattern").agg(F.count("*").alias("times")).orderBy("pattern").toPandas()
    model = label_model(unpacked(found["pattern"].to_numpy(np.int64)), found["times"].to_numpy(float))
    share = max(float(found["times"].sum()), 1.0)
    # A stretch of the hash's range that holds several times the rows wanted, so that the sample need not sort the table.
    near: Column = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 8 * rows / share) * (1 << 30))
    picked = docs.where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).where(near).select("doc_id", "text")
    got = picked.orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text")).limit(rows).select("text").toPandas()["text"].tolist()
    good = model.posterior(votes(got)) if got else np.zeros(0)
    return model, fit(got, good)


def classify(docs: DataFrame, label: LabelModel, scorer: Scorer, keep: float = KEEP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, posterior (of the votes), score (of the scorer), keep."""
    shared = docs.sparkSession.sparkContext.broadcast((label, scorer))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, scorer = shared.value
        for part in parts:
            texts = part.column("text").to_pylist()
            v, score = votes(texts), scorer.score(texts)
            names = ["doc_id", "posterior", "score", "keep", *(f"vote_{x}" for x in LABELLERS)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(label.posterior(v)), pa.array(score), pa.array(score >= keep), *(pa.array(v[:, k].astype(np.int32)) for k in range(v.shape[1]))], names=names)

    kinds = "doc_id long, posterior double, score double, keep boolean, " + ", ".join(f"vote_{x} int" for x in LABELLERS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, *train(docs))
