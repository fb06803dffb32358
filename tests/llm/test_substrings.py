"""Substring dedup against brute force: what is cut, row by row, with repeated and null ids."""

import random

from treeline.llm import op1_substrings


def prose(r, n):
    return " ".join("".join(r.choice("aeiounrstlmé") for _ in range(r.randint(2, 9))) for _ in range(n))


def brute(rows, min_words):
    """(doc_id, text) -> spans: chunk pairs that a lower id has, merged, counted in words by keeper."""
    made = {}
    for d, t in set(rows):
        for _, digest, a, z, u, v in op1_substrings.chunks([t]):
            made[d, t] = list(zip(digest.tolist(), a.tolist(), z.tolist(), u.tolist(), v.tolist(), strict=True))
    least = {}
    for (d, _), chunk in made.items():
        for x, *_ in chunk:
            if d is not None:
                least[x] = min(least.get(x, d), d)
    out = {}
    for (d, t), chunk in made.items():
        runs = []
        for x, a, z, u, v in sorted(chunk, key=lambda c: c[1:3]):
            if x in least and least[x] != d:
                if not runs or a > max(c[1] for c in runs[-1]):
                    runs.append([])
                runs[-1].append((a, z, u, v, least[x]))
        spans = []
        for run in runs:
            by = {}
            for a, z, u, v, lo in run:
                by.setdefault(lo, []).append((a, z, u, v))
            good = [c for cs in by.values() if max(c[3] for c in cs) - min(c[2] for c in cs) >= min_words for c in cs]
            if good:
                spans.append((min(c[0] for c in good), max(c[1] for c in good)))
        out[d, t] = spans
    return out


def cut(text, spans):
    out, at = "", 0
    for a, z in spans:
        out, at = out + text[at:a], z
    return out + text[at:]


def test_rows_are_cut_one_by_one(spark):
    r = random.Random(6)
    passages = [prose(r, 60) for _ in range(6)]
    rows = [(k, prose(r, 40) + " " + passages[k % 6] + " " + prose(r, 30)) for k in range(30)]
    rows += [(10, prose(r, 90)), (10, prose(r, 20) + passages[1]), (10, prose(r, 50)), (None, prose(r, 30) + " " + passages[2]), (None, prose(r, 70)), (None, prose(r, 70)), rows[7], rows[7], (None, passages[3] + passages[3]), (77, None), (78, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute([x for x in rows if x[1]], 16)
    assert sum(map(bool, want.values())) >= 25
    got = {}
    for x in op1_substrings.repeats(docs).collect():
        got.setdefault(x.text_hash, []).append((x.doc_id, x.start, x.end))
    assert sorted(map(str, (sorted(v) for v in got.values()))) == sorted(str(sorted((d, a, z) for a, z in s)) for (d, _), s in want.items() if s)
    texts = sorted((x.doc_id or -1, x.text or "") for x in op1_substrings.dedup(docs).collect())
    assert texts == sorted((d or -1, cut(t, want[d, t]) if t else "") for d, t in rows)


def test_text_without_chunk_ends_is_cut_after_a_length():
    for unit in ("ab", "é ", "a", "xyz 中"):
        text = unit * 4000
        pieces = [(int(a), int(z)) for _, _, a, z, _, _ in op1_substrings.chunks([text]) for a, z in zip(a, z, strict=True)]
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(len(text[a:z].encode()) <= 2 * op1_substrings.LONGEST + 6 for a, z in pieces)
