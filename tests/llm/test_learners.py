"""The learners of the quality and toxicity operators against plain Python, and on true labels they don't see."""

import math
import os
import random

import numpy as np
import pytest

from treeline.llm import op7_quality, op9_toxicity

DATA = "/root/testdata/sf0.01"


def brute_em(ballots, rounds):
    """EM document by document, with plain loops. ballots: one list of votes each."""
    m, n = len(ballots[0]), len(ballots)
    start = [[[op7_quality.START[c][x] if any(b[k] == x - 1 for b in ballots) else 1e-9 for x in range(3)] for k in range(m)] for c in (0, 1)]
    start = [[[v / sum(row) for v in row] for row in c] for c in start]
    prior, rate, hold = op7_quality.PRIOR, start, op7_quality.HOLD * n + 1

    def posterior(b):
        bad, good = 1 - prior, prior
        for k, v in enumerate(b):
            bad, good = bad * rate[0][k][v + 1], good * rate[1][k][v + 1]
        return good / (good + bad)

    for _ in range(rounds):
        weight = [(1 - p, p) for p in map(posterior, ballots)]
        total = [sum(w[c] for w in weight) for c in (0, 1)]
        rate = [[[(sum(w[c] for w, b in zip(weight, ballots, strict=True) if b[k] == x - 1) + hold * start[c][k][x]) / (total[c] + hold) for x in range(3)] for k in range(m)] for c in (0, 1)]
        prior = (total[1] + hold * op7_quality.PRIOR) / (n + hold)
    return prior, [posterior(b) for b in ballots]


def test_label_model_is_that_of_plain_em(spark):
    r = random.Random(12)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 9))) for _ in range(80)]
    make = [lambda: " ".join(r.choices(words, k=60)) + ".", lambda: "BUY NOW!!! $$$ " * r.randint(2, 20), lambda: " ".join(r.choices(words, k=8)), lambda: "a|b\t" * 40, lambda: (r.choice(words) + " ") * 30]
    rows = [(k, make[min(4, r.randrange(9)) if k % 3 else 0]()) for k in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label, scorer = op7_quality.train(docs)
    ballots = op7_quality.votes([t for _, t in rows]).tolist()
    prior, want = brute_em(ballots, 400)
    assert label.prior == pytest.approx(prior, abs=1e-5)
    got = {x.doc_id: x for x in op7_quality.classify(docs, label, scorer).collect()}
    assert [got[d].posterior for d, _ in rows] == pytest.approx(want, abs=1e-4)
    assert [[got[d][f"vote_{x}"] for x in op7_quality.LABELLERS] for d, _ in rows] == ballots
    assert all(got[d].keep == (got[d].score >= op7_quality.KEEP) for d, _ in rows)
    assert np.mean([(got[d].score > 0.5) == (p > 0.5) for (d, t), p in zip(rows, want, strict=True) if t]) > 0.95


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_on_true_labels(spark):
    truth = {x.doc_id: x.quality for x in spark.read.parquet(f"{DATA}/labels.parquet").collect() if x.quality is not None}
    got = [(x.score, truth[x.doc_id]) for x in op7_quality.query(spark, DATA).collect() if x.doc_id in truth]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    assert len(good) > 20 and len(bad) > 20
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97


def brute_features(text):
    """(kind, what): occurrences of words, stems, pairs and skip-pairs."""
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out = [("word", x) for x in w] + [("pair", *p) for p in zip(w, w[1:], strict=False)] + [("skip", *p) for p in zip(w, w[2:], strict=False)]
    return out + [("stem", n, x[:n]) for n in op9_toxicity.STEMS for x in w if len(x) >= n]


def test_features_are_words_stems_pairs_and_skips():
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "be", "gammaray", "Delta's", "x-y", "omicron"]) for _ in range(r.randint(0, 30))) for _ in range(40)]
    seen = {}
    for first, count, slots, owner in op9_toxicity.features(texts):
        for k in range(count):
            want, got = brute_features(texts[first + k]), slots[owner == k].tolist()
            assert len(got) == len(want)
            times = lambda x: sorted(x.count(v) for v in set(x))
            assert times(got) == times(want)
            seen |= dict.fromkeys(got)
    assert len(seen) <= len({f for t in texts for f in brute_features(t)})


def test_fit_is_plain_ftrl_proximal():
    r = random.Random(9)
    words = ["".join(r.choice("aeinrst") for _ in range(5)) for _ in range(60)]
    rows = []
    for k in range(300):
        w = r.choices(words, k=12)
        if k % 3 == 0:
            w[5] = r.choice(["vileword", "foulword"])
        rows.append((k, int(k % 3 == 0), " ".join(w)))
    each = []
    for _, count, slots, owner in op9_toxicity.features([t for *_, t in rows]):
        for k in range(count):
            have, times = np.unique(slots[owner == k], return_counts=True)
            each.append({int(s) for s in have} | {int(s) ^ x for n, x in op9_toxicity.OFTEN for s in have[times >= n]} | {"bias"})
    z, n = {}, {}

    def weight(i):
        bound = 0.0 if i == "bias" else op9_toxicity.L1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= bound else -(v - math.copysign(bound, v)) / ((op9_toxicity.BETA + math.sqrt(n.get(i, 0.0))) / op9_toxicity.ALPHA + op9_toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(max(1, min(op9_toxicity.MOST_EPOCHS, op9_toxicity.STEPS // len(rows)))):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in each[k]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - rows[k][1]
            for i in each[k]:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / op9_toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    model = op9_toxicity.fit(rows)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert model.bias == pytest.approx(weight("bias"), abs=1e-6)
    assert dict(zip(model.slots.tolist(), model.values.tolist(), strict=True)) == pytest.approx(want, abs=1e-6)
    assert 0 < len(want) < 0.2 * len(z)
