"""Runs of words against all periods tried one by one, and what the query makes of them."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from treeline.llm import op11_runs


def plain(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    return tried(tuple(words), least, times)


@functools.cache
def tried(words: tuple, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period): every period, from the least on, and every stretch that keeps it."""
    known: dict[bytes, int] = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // times + 1):
        edge = np.flatnonzero(np.diff(x[q:] == x[:-q], prepend=False, append=False)).tolist()
        for start, stop in zip(edge[::2], edge[1::2], strict=True):
            if stop + q - start >= max(least, times * q):
                found.setdefault((start, stop + q), q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def text(rng: random.Random) -> list[bytes]:
    draw = lambda n, k: [rng.randrange(k) for _ in range(n)]
    out: list[int] = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(5)
        if kind == 0:
            out += draw(rng.randrange(20), rng.choice([1, 2, 3, 30]))
        elif kind == 1 and out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 40)]
        elif kind == 2:
            out += draw(rng.randrange(1, 8), 3) * rng.randrange(1, 9)
        elif kind == 3:
            out += (draw(rng.randrange(1, 4), 2) * rng.randrange(2, 7) + draw(2, 5)) * rng.randrange(1, 7)
        else:
            a, b = [0], [0, 1]
            for _ in range(rng.randrange(2, 8)):
                a, b = b, b + a
            out += b
    return [b"%d" % w for w in out]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 3), (4, 5)])
def test_all_runs(least, times):
    rng = random.Random(10 * least + times)
    for _ in range(250):
        texts = [text(rng) for _ in range(rng.randrange(1, 7))]
        texts += [list(texts[0]), [b"7", *texts[0]]]  # blocks of the parse that hold whole texts
        for words, got in zip(texts, op11_runs._block(texts, least, times), strict=True):
            assert [tuple(r) for r in got.tolist()] == plain(words, least, times)


def test_long_texts_of_one_word_and_of_none_that_repeats():
    texts = [[b"a"] * 200_000, [b"%d" % k for k in range(200_000)], []]
    got = op11_runs._block(texts, 6, 4)
    assert [g.tolist() for g in got] == [[[0, 200_000, 1]], [], []]


def test_parts():
    rng = np.random.default_rng(3)
    x = rng.permutation(5000)
    want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(400)]
    assert op11_runs.smaller_before(x)[:400].tolist() == want
    assert op11_runs.smaller_before(np.arange(300)[::-1].copy()).tolist() == [-1] * 300
    y = np.append(rng.integers(0, 2, 300), 9)
    order, names = op11_runs.suffixes(y)
    assert order.tolist() == sorted(range(301), key=lambda i: y[i:].tolist())
    length, source = op11_runs.previous_factors(order, names)
    for i in range(300):
        lcp = [next((k for k in range(301) if i + k > 300 or y[i + k] != y[j + k]), 0) for j in range(i)]
        assert length[i] == max(lcp, default=0) and (not length[i] or lcp[source[i]] == length[i])


def expected(doc_id, raw):
    words = (raw or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words, 6, 4)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()
    best = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    return (doc_id, len(runs), *best, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_over_odd_rows(spark, odd, tmp_path):
    rng = random.Random(5)
    more = [(k, b" ".join(text(rng)).decode(), None, None, None) for k in range(100, 400)] + [(500, "x y " * 9 + "\x1c" + " é\x0bé" * 7, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_runs.query(spark, str(tmp_path))
    want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 100


def test_empty_table_and_plain_operator(spark, empty):
    assert op11_runs.periodic(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b a b a b a b c")], "doc_id long, text string")
    r = op11_runs.periodic(docs).first()
    assert r.collapsed == "a b c" and [tuple(x) for x in r.runs] == [(0, 8, 2)]
