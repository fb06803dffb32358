"""Language identification with blended-spectrum n-gram presence kernels.

The kernel of two texts is the mean, over n = 1, 2, 3, of the cosine of their sets of character n-grams (lower-cased;
all characters that no landmark text has as a letter count as one separator; letters of every script have a class of
their own). The n-grams counted are those of the
landmark texts, so kernels against all landmarks are one product of a presence matrix and the landmark matrix. Nyström:
the landmarks' kernel matrix gives the feature map, on which one ridge regression per language is fitted.

The fit takes a bounded sample of labelled rows: at most FIT_ROWS texts of at most FIT_CHARS code points each, of which
LANDMARKS serve as landmarks, the same number from each language as far as there are so many. Every text is scored whole.

Defined results for odd input: null text and text without a letter give ``und`` and score 0; without any labelled row
to learn from, every text gives ``und``; a null doc_id hashes as empty text, hence held out; repeated rows are scored
each; ties go to the language first by code point; texts of any length are scored whole; an empty table gives no rows;
other columns are ignored. What is broadcast is bounded and checked, at most MOST_MB = 200 MB: COLUMNS n-grams of LANDMARKS
texts (67 MB; of more n-grams those that most landmarks have), tables of DENSE slots, and a class for each code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.sampling import labelled_sample, remainder

NAME = "op3_language"
FIT_ROWS = 2400
FIT_CHARS = 20_000
LANDMARKS = 128
RIDGE = 1e-3
NONE = "und"
LETTER = regex.compile(r"\p{L}")
LAST = 0x10FFFF
ORDERS = (1, 2, 3)
DENSE = 1 << 22  # as many possible n-grams have a slot each; of more, those of the landmarks are searched
HELD = 20  # labelled texts outside the landmarks that a language's least share is taken from
LONG = 30  # trigrams of such a text
LOW = 0.01  # quantile of their shares
TOWARDS = 1 / 3
OF_MANY = 0.1  # of a language's landmarks must have a trigram, so that passages in another language don't count
SIGMAS = 3
CELLS = 1 << 24  # of a presence matrix
COLUMNS = 1 << 17  # n-grams that the model knows at most, 4 bytes a landmark each
MOST_MB = 200  # of a model


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  # code point -> class; 0: no letter; -1: a letter that no landmark has
    many: int  # classes
    grams: list[np.ndarray]  # for n = 1, 2, 3: the landmarks' n-grams in order, as numbers to the base ``many``
    tables: list[np.ndarray | None]  # n-gram -> column, or the spare last column; None: over DENSE
    spans: list[tuple[int, int]]  # columns of each n
    landmarks: np.ndarray  # column x landmark
    weights: np.ndarray  # landmark x language
    bias: np.ndarray
    having: np.ndarray | None = None  # language x column: how many of its landmarks have the trigram
    times: np.ndarray | None = None  # of each language: how many of them must have it
    least: np.ndarray | None = None  # of each language: the share of known trigrams that a text of it must have

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.maximum(self.classes[points], 0).astype(np.int64)

    def known(self, text: str, lang: int, itself: int = 0) -> tuple[int, int]:
        """How many of the text's trigrams the language's landmarks have (itself: is it one of them?), and how many have a letter."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        one = self.classes[points].astype(np.int64)
        every = one[:-2] | one[1:-1] | one[2:]  # negative where a letter is strange
        at = np.flatnonzero(every > 0)
        gram = (one[at] * self.many + one[at + 1]) * self.many + one[at + 2]
        return int((self.having[lang, self.columns(3, gram)] >= self.times[lang] + itself).sum()), int(np.count_nonzero(every))

    def foreign(self, text: str, lang: int) -> bool:
        """Whether fewer of the text's trigrams are known than must be, by more than chance in a text of its length."""
        has, n = self.known(text, lang)
        p = self.least[lang]
        return has + SIGMAS * np.sqrt(n * p * (1 - p)) < n * p

    def columns(self, n: int, gram: np.ndarray) -> np.ndarray:
        if self.tables[n - 1] is not None:
            return self.tables[n - 1][gram]
        known = self.grams[n - 1]
        if not len(known):
            return np.full(len(gram), self.spans[-1][1])
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        return np.where(known[at] == gram, self.spans[n - 1][0] + at, self.spans[-1][1])

    def batch(self) -> int:
        """How many texts are scored at once."""
        return max(1, min(256, CELLS // (self.spans[-1][1] + 1)))

    def ngrams(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        one = gram = self.codes(text)
        for n in ORDERS:
            if len(one) < n:
                break
            if n > 1:
                gram = gram[:-1] * self.many + one[n - 1 :]
            yield n, gram

    def presence(self, texts: list[str]) -> np.ndarray:
        """text x column: 1 over the root of the number of the text's n-grams of that n, where it has the n-gram."""
        out = np.zeros((len(texts), self.spans[-1][1] + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for n, gram in self.ngrams(text):
                row[self.columns(n, gram)] = 1
        for a, b in self.spans:
            out[:, a:b] /= np.sqrt(np.maximum(out[:, a:b].sum(1, keepdims=True), 1))
        return out[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.presence(texts) @ self.landmarks @ self.weights + self.bias


def fit(rows: list[tuple[int, str, str]]) -> Model | None:
    """rows: (doc_id, lang, text)."""
    rows = [r for r in rows if LETTER.search(r[2])]
    langs = sorted({r[1] for r in rows})
    if not langs:
        return None
    turn, ranked = dict.fromkeys(langs, 0), []
    for i, r in enumerate(rows):
        turn[r[1]] += 1
        ranked.append((turn[r[1]], i))
    chosen = [i for _, i in sorted(ranked)[:LANDMARKS]]
    texts = [rows[i][2] for i in chosen]
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    classes = np.array([-c.isalpha() for c in map(chr, range(LAST + 1))], np.int32)
    for k, c in enumerate(letters):
        classes[ord(c)] = k + 1
    many = len(letters) + 1
    model = Model(langs, classes, many, [], [], [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(len(langs)))
    seen: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in ORDERS]
    for t in texts:
        for n, gram in model.ngrams(t):
            seen[n - 1].append(np.unique(gram))
    model.grams = commonest([np.concatenate(x) for x in seen])
    ends = np.cumsum([0, *map(len, model.grams)]).tolist()
    model.spans = list(zip(ends[:-1], ends[1:], strict=True))
    for n, known, first in zip(ORDERS, model.grams, ends, strict=False):
        table = np.full(many**n, ends[-1], np.int32) if many**n <= DENSE else None
        if table is not None:
            table[known] = np.arange(first, first + len(known))
        model.tables.append(table)
    marks = model.presence(texts) / len(ORDERS)
    model.landmarks = np.ascontiguousarray(marks.T.astype(np.float32))
    within = (model.presence(texts) @ model.landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((within + within.T) / 2)
    big = value > max(value.max(), 0) * 1e-7
    to_features = vector[:, big] / np.sqrt(value[big])
    kernel = np.concatenate([model.presence([r[2] for r in rows[k : k + model.batch()]]) @ model.landmarks for k in range(0, len(rows), model.batch())]).astype(np.float64)
    x = kernel @ to_features
    y = np.where(np.array([r[1] for r in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    mean_x, mean_y = x.mean(0), y.mean(0)
    x0 = x - mean_x
    beta = np.linalg.solve(x0.T @ x0 + RIDGE * len(rows) * np.eye(x.shape[1]), x0.T @ (y - mean_y))
    model.weights = (to_features @ beta).astype(np.float32)
    model.bias = (mean_y - mean_x @ beta).astype(np.float32)
    first, last = model.spans[-1]
    of = np.array([langs.index(rows[i][1]) for i in chosen])
    model.times = np.array([max(1, round(OF_MANY * (of == k).sum())) for k in range(len(langs))])
    model.having = np.zeros((len(langs), last + 1), np.int32)
    for k in range(len(langs)):
        model.having[k, first:last] = (model.landmarks[first:last, of == k] > 0).sum(1)
    model.least = np.array([least_share(model, k, rows, set(chosen)) for k in range(len(langs))])
    return model


def commonest(seen: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct n-grams of each n in order; of more than COLUMNS those that most landmarks have."""
    found = [np.unique(x, return_counts=True) for x in seen]
    times = np.concatenate([n for _, n in found])
    keep = np.zeros(len(times), bool)
    keep[np.argsort(-times, kind="stable")[:COLUMNS]] = True
    ends = np.cumsum([0, *(len(x) for x, _ in found)])
    return [x[keep[a:b]] for (x, _), a, b in zip(found, ends[:-1], ends[1:], strict=True)]


def megabytes(model: Model | None) -> float:
    """What the arrays of a model take."""
    held = [model.classes, *model.grams, *model.tables, model.landmarks, model.weights, model.having] if model else []
    return sum(x.nbytes for x in held if x is not None) / 1e6


def shared_model(spark: SparkSession, model: Model | None):
    """The broadcast model; an error if it is over MOST_MB, which COLUMNS rules out for up to 50 languages."""
    if megabytes(model) > MOST_MB:
        raise ValueError(f"the language model takes {megabytes(model):.0f} MB, and {MOST_MB} may be broadcast")
    return spark.sparkContext.broadcast(model)


def least_share(model: Model, lang: int, rows: list[tuple[int, str, str]], chosen: set[int]) -> float:
    """The share of known trigrams that a text of the language must have, between its labelled texts and the others'.

    It lies TOWARDS of the way from what all but the LOW lowest of its own texts have to the median of the texts in other
    languages; without these, to 0. Its own texts are those that are no landmarks; where they are fewer than HELD,
    landmarks count too, each against the others.
    """

    def shares(got: list[tuple[int, int]]) -> list[float]:
        return [has / n for has, n in got if n >= LONG] or [has / n for has, n in got if n]

    own = [i for i, r in enumerate(rows) if r[1] == model.langs[lang]]
    out = [i for i in own if i not in chosen]
    got = [model.known(rows[i][2], lang) for i in out]
    if len(out) < HELD:
        got += [model.known(rows[i][2], lang, 1) for i in own if i in chosen]
    low = np.quantile(shares(got), LOW, method="lower") if shares(got) else 0.0
    others = shares([model.known(r[2], lang) for r in rows if r[1] != model.langs[lang]])
    return float(low - TOWARDS * max(0.0, low - (np.median(others) if others else 0.0)))


def train(docs: DataFrame, rows: int = FIT_ROWS, most_chars: int = FIT_CHARS) -> Model | None:
    """docs(doc_id, text, lang): learns from rows whose remainder is not 0 and whose lang is known."""
    labels = docs.where(F.col("lang").isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return fit(labelled_sample(docs.select("doc_id", "text"), labels, "lang", rows, most_chars, docs.count()))


def predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, score = [NONE] * len(texts), np.zeros(len(texts))
    able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    step = model.batch() if model else 1
    for k in range(0, len(able), step):
        some = able[k : k + step]
        got = model.scores([texts[i] for i in some])
        best = got.argmax(1)
        score[some] = np.clip((got[np.arange(len(some)), best] + 1) / 2, 0, 1)
        for i, b in zip(some, best, strict=True):
            langs[i] = model.langs[b]
    return langs, score


def predictor(model):
    """A mapInArrow function. model: a broadcast Model or None."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, score = predicted(model.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    shared = shared_model(spark, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs whose text is in a language that was learnt, with a score of at least ``least``; all columns stay.

    The score alone rejects little: the languages' outputs add up to 2 - L, so the best of L scores is 1 / L at least. What
    tells a foreign text or junk is that too few of its trigrams are known from the language it was given (Model.foreign).
    """
    shared = shared_model(docs.sparkSession, model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            model, texts = shared.value, part.column("text").to_pylist()
            langs, score = predicted(model, texts)
            keep = [x != NONE and s >= least and not model.foreign(t, model.langs.index(x)) for t, x, s in zip(texts, langs, score, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
