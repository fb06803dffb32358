"""Decontamination over large corpora and long items."""

import random

import numpy as np
import pytest

from treeline.llm import op10_decontaminate as op10


def prose(r, n, lexicon=None):
    return [r.choice(lexicon) if lexicon else "".join(r.choice("aeiounrstlm") for _ in range(r.randint(3, 9))) for _ in range(n)]


def leaks(model, texts):
    return {(b.first + t, model.items[k].item_id) for b in op10.word_blocks(texts) for t, k, *_ in op10.leaks_of(model, b)}


def test_candidates_do_not_depend_on_the_number_of_documents(spark):
    r = random.Random(12)
    lexicon = prose(r, 300)
    texts = [prose(r, 40, lexicon) for _ in range(60)]
    items = op10.items_of([(k, " ".join(t)) for k, t in enumerate(texts)])
    terms = np.unique(np.concatenate([x.words for x in items]))
    share = np.random.default_rng(1).choice([0.0002, 0.01, 0.3, 0.6], len(terms), p=[0.1, 0.1, 0.4, 0.4])
    docs = [" ".join(prose(r, 60) + [x if j >= 34 or r.random() > 0.35 else prose(r, 1)[0] for j, x in enumerate(t)] + prose(r, 60)) for t in texts]
    found = {}
    for n in (10_000, 15_000_000, 10**12):
        model = op10.fitted(spark, items, terms, share * n, n)
        found[n] = leaks(model, docs)
        assert model.other == pytest.approx(0.6 * np.log(10_001)) and model.weight.max() <= np.log(10_001) + 0.1
    assert found[10_000] == found[15_000_000] == found[10**12] and len(found[10_000]) >= 50


@pytest.mark.parametrize(("n", "quoted"), [(150, 100), (300, 160), (300, 72), (66, 60), (1000, 72), (150, 50), (300, 48), (1000, 50)])
def test_a_long_part_of_a_long_item_is_a_leak(spark, n, quoted):
    r = random.Random(n + quoted)
    item, filler = prose(r, n), prose(r, 400)
    items = op10.items_of([(7, " ".join(item))])
    terms = np.unique(items[0].words)
    model = op10.fitted(spark, items, terms, np.full(len(terms), 3.0), 1000)
    for at in range(0, n - quoted, max(1, (n - quoted) // 9)):
        docs = [" ".join([*prose(r, before, filler), *item[at : at + quoted], *prose(r, 90, filler)]) for before in (0, 45, 200)]
        assert leaks(model, docs) == {(0, 7), (1, 7), (2, 7)}
    short = [" ".join([*prose(r, 90, filler), *item[5 : 5 + quoted // 4], *prose(r, 90, filler)]) for _ in range(5)]
    assert not leaks(model, [*short, " ".join(prose(r, 900, filler))])


def test_latent_candidates_against_all_pairs_cosine(spark):
    """Of all windows and passages whose whole TF-IDF vectors have a cosine of 0.18, at least 0.98 are candidates; a space
    has half as many dimensions as passages, and paraphrases are found in it."""
    r = random.Random(31)
    lexicon = prose(r, 2500)
    share = [1 / (k + 3) for k in range(len(lexicon))]
    draw = lambda n: r.choices(lexicon, share, k=n)
    items = [(k, draw(r.randint(20, 60))) for k in range(90)]
    texts = [draw(150) for _ in range(250)]
    for k, t in items:
        texts += [draw(70) + t + draw(50), draw(40) + [x if r.random() > 0.2 else r.choice(lexicon) for x in t] + draw(60)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    (model,) = op10.train(docs, bench)
    assert model.spaces[0].passages.shape == (90, 45)
    passages = np.zeros((90, len(model.terms)))
    for k, t in enumerate(model.items):
        w, times = np.unique(op10.lookup(model.terms, t.words), return_counts=True)
        passages[k, w] = model.weight[w] * times
    passages /= np.linalg.norm(passages, axis=1, keepdims=True)
    near = found = 0
    for b in op10.word_blocks([" ".join(t) for t in texts]):
        best, start, stop = op10.candidates(model, b)
        got = {(w, k) for (_, k), hits in best.items() for _, w in hits}
        at = op10.lookup(model.terms, b.value)
        for w, (i, j) in enumerate(zip(start, stop, strict=True)):
            known = at[i:j][at[i:j] >= 0]
            norm = np.sqrt((model.weight[known] ** 2).sum() + (j - i - len(known)) * model.other**2)
            close = np.flatnonzero(passages @ np.bincount(known, model.weight[known], len(model.terms)) / norm >= 0.18)
            near += len(close)
            found += sum((w, int(k)) in got for k in close)
    assert near >= 180 and found >= 0.98 * near
    leaked = {(x.doc_id, x.item_id) for x in op10.leaks(docs, [model]).collect()}
    assert {(250 + 2 * k, k) for k, _ in items} <= leaked and len({(251 + 2 * k, k) for k, _ in items} & leaked) >= 81


def test_shards_of_a_benchmark_find_the_same(spark, monkeypatch):
    r = random.Random(8)
    items = [(k, " ".join(prose(r, 30))) for k in range(30)]
    rows = [(k, " ".join([*prose(r, 40), t, *prose(r, 40)])) for k, t in items] + [(100 + k, " ".join(prose(r, 80))) for k in range(30)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op10, "SHARD_WORDS", 300)
    models = op10.train(docs, bench)
    assert len(models) == 3
    assert {(x.doc_id, x.item_id) for x in op10.leaks(docs, models).collect()} == {(k, k) for k, _ in items}
    assert {x.doc_id for x in op10.clean(docs, models).collect()} == {100 + k for k in range(30)}
