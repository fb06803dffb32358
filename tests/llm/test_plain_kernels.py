"""Hashed kernels against plain Python, byte by byte: chunk ends, fingerprints, the features and fit of the scorer."""

import math
import random

import numpy as np

from treeline.llm import op1_substrings, op5_fingerprint, op7_quality, words

M = (1 << 64) - 1


def prose(r, n):
    return " ".join("".join(r.choice("aeiounrstlmé中") for _ in range(r.randint(1, 9))) for _ in range(n))


def mix(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def word_hash(raw):
    return mix(sum((c + 1) * pow(words.P, i, 1 << 64) for i, c in enumerate(raw)) & M)


def gear_ends(raw):
    """Places after which a chunk ends: the gear hash of the last 16 bytes is low, inside of none of the 11 bytes before."""
    gear = [mix((k + 1) * words.P & M) >> 32 for k in range(256)]
    low = []
    for i in range(op1_substrings.REACH, len(raw)):
        h = sum(gear[raw[i - k]] << k for k in range(16)) & 0xFFFFFFFF
        if h * 0x9E3779B1 & 0xFFFFFFFF < (1 << 32) // 20 and (i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80):
            low.append(i)
    return [i for i, before in zip(low, [None, *low], strict=False) if before is None or i - before >= op1_substrings.GAP]


def test_gear_hash():
    r = random.Random(1)
    for n in (0, 3, 40, 300):
        raw = prose(r, n).encode()
        data = np.frombuffer(raw + b"\n", np.uint8)
        got = [i for i in op1_substrings.ends(data, np.array([0, len(data)])).tolist() if i < len(raw) - 1]
        assert got == [i for i in gear_ends(raw + b"\n") if i < len(raw) - 1]
        assert n < 300 or len(got) > 10


def piecewise(text):
    raw = text.encode()
    if not raw:
        return "0::"
    hashes = []
    for i in range(len(raw)):
        h = sum((raw[i - k] + 1) * pow(op5_fingerprint.ROLL, k, 1 << 32) for k in range(min(7, i + 1))) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)

    def cut(k):
        stops = [i + 1 for i, h in enumerate(hashes) if h % (1 << k) == 0]
        return stops if stops and stops[-1] == len(raw) else [*stops, len(raw)]

    k = next(k for k in range(40) if len(cut(k)) <= 64)

    def signs(k):
        out = ""
        for a, z in zip([0, *cut(k)], cut(k), strict=False):
            v = sum((c + 1) * pow(op5_fingerprint.CHUNK, i, 1 << 64) for i, c in enumerate(raw[a:z])) & M
            v ^= v >> 29
            out += chr(op5_fingerprint.SIGNS[(v * 0xBF58476D1CE4E5B9 & M) >> 58])
        return out

    return f"{k}:{signs(k)}:{signs(k + 1)}"


def test_fingerprints():
    r = random.Random(2)
    for text in ["", "a", "short text", "x" * 500, *(prose(r, n) for n in (5, 12, 40, 100, 300, 700))]:
        assert op5_fingerprint.shown(op5_fingerprint.fingerprint(text)) == piecewise(text)


def plain_features(text):
    """Slot -> times, and what sums are divided by."""
    kind = lambda c: 3 if c >= 128 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 + c % 16
    w = text.encode().split()
    value = [word_hash(x) for x in w]
    found = list(value)
    found += [mix(mix(a + 2 & M) + b & M) for a, b in zip(value, value[1:], strict=False)]
    found += [mix((((kind(x[-1]) * 32 + kind(x[0])) * 32 + kind(x[min(1, len(x) - 1)])) * 16 + min(len(x), 15)) + (1 << 32)) for x in w]
    found += [mix(77) for a, b in zip(value, value[1:], strict=False) if a == b]
    slots = {}
    for f in found:
        slots[f >> 64 - op7_quality.BITS] = slots.get(f >> 64 - op7_quality.BITS, 0) + 1
    return slots, math.sqrt(max(1, len(found)))


def test_scorer(monkeypatch):
    r = random.Random(3)
    texts = [prose(r, n) for n in (3, 8, 20, 30, 1)] + ["Same same SAME same same 12 12 x.", "", None, "A b C d, é!"]
    good = np.array([r.random() for _ in texts])
    w, total, each = {}, {}, []
    for t in texts:
        slots, size = plain_features(t or "")
        each.append({k: n / size for k, n in slots.items()} | {1 << op7_quality.BITS: 1.0})
    order = np.random.default_rng(5)
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-35, min(35, x))))
    for _ in range(op7_quality.EPOCHS):
        for k in order.permutation(len(each)):
            off = sigmoid(sum(w.get(i, 0) * x for i, x in each[k].items())) - good[k]
            for i, x in each[k].items():
                g = off * x + 1e-5 * w.get(i, 0)
                total[i] = total.get(i, 1e-6) + g * g
                w[i] = w.get(i, 0) - 0.15 * g / math.sqrt(total[i])
    want = [sigmoid(sum(w.get(i, 0) * x for i, x in e.items())) for e in each]
    scorer = op7_quality.fit(texts, good)
    assert np.allclose(scorer.score(texts), want, atol=1e-5) and max(want) - min(want) > 0.05
    assert scorer.score([texts[0] + " y", "y " + texts[1]])[1] == scorer.score(["y " + texts[1]])[0]  # texts don't touch
