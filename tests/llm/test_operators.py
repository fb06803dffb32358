"""Whole operators against brute force, their SQL, and cases planted in invented text."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treeline.llm import op1_substrings, op3_language, op4_mix, op6_join, op8_html, op9_toxicity, op10_decontaminate, registry

DATA = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def prose(r, n, lexicon=None):
    return " ".join(r.choice(lexicon) if lexicon else "".join(r.choice("aeiounrstlm") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    r = random.Random(2)
    rows = []
    for k in range(120):
        passage = prose(r, 51)
        rows += [(10 * k, prose(r, 80)), (10 * k + 1, f"{prose(r, 30 + k)} {passage} {prose(r, 20)}"), (10 * k + 2, f"{prose(r, 15)} {passage} {prose(r, 40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = op1_substrings.repeats(docs).collect()
    assert {(x.doc_id, *x.first_doc_ids) for x in got} == {(10 * k + 2, 10 * k + 1) for k in range(120)}
    assert all(text[x.doc_id][x.start : x.end] in text[x.first_doc_ids[0]] for x in got)
    cut = {x.doc_id: x.text for x in op1_substrings.dedup(docs).collect()}
    assert all(len(cut[d]) == len(t) - sum(x.end - x.start for x in got if x.doc_id == d) for d, t in text.items())


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "rare", "short", "block"), [(3, 90, 64, 8, 256), (3, 90, 2, 3, 8), (5, 80, 3, 2, 4)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, n, percent, rare, short, block):
    monkeypatch.setattr(op6_join, "SHORT", short)
    monkeypatch.setattr(op6_join, "BLOCK", block)
    r = random.Random(n * 100 + rare)
    lexicon, rows = [prose(r, 1) for _ in range(300)], []
    notice = prose(r, 25, lexicon)
    for family in range(14):
        base = prose(r, r.choice([12, 40, 90, 200]), lexicon).split()
        for _ in range(r.choice([1, 3, 24])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(lexicon)
            if family % 3 == 0:
                w += notice.split()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "a b", "a b", "A  b", "one"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows, n, percent)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert {tuple(x) for x in op6_join.groups(docs, n, percent, rare).collect()} == want
    if n == 5:
        kept = {x.doc_id for x in op6_join.one_of_each(docs, n, percent).collect()}
        assert kept == {c for _, _, c in want}


def test_mix_matches_its_sql(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(60) if k % 9 else None, prose(r, r.choice([0, 1, 5, 40])) if k % 7 else None, r.choice(["b", "a", None, "é"]) if k % 3 else "hot") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_mix.query(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, size, source_size, target, taken"
    want = c.execute(f"SELECT {names} FROM ({op4_mix.ORACLE})").fetchall()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(x[n] for n in names.split(", ")) for x in got), key=key) == sorted(want, key=key)
    assert sum(x.taken for x in got) == pytest.approx(sum(x["size"] for x in got), rel=0.05)


def test_mix_of_null_and_equal_ids_meets_its_targets(spark, tmp_path):
    """Rows without ids, with texts of one length or one text, in two sources: each source's words come near its target."""
    for k, text in enumerate((lambda i: f"w{i} " * 5, lambda i: "one and the same text")):
        rows = [(None, text(i), "a" if i % 2 else "b") for i in range(4000)]
        folder = tmp_path / str(k)
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(folder / "documents.parquet"))
        got = op4_mix.query(spark, str(folder)).toPandas()
        sums = got.groupby("target").agg(taken=("taken", "sum"))
        assert len(sums) == 2 and all(abs(r.taken - target) <= 5 for target, r in sums.iterrows())
        docs = spark.read.parquet(str(folder / "documents.parquet")).withColumn("size", F.lit("x"))
        mixed = op4_mix.mixed(docs).toPandas()
        assert mixed.columns.tolist() == ["doc_id", "text", "source", "size", "taken"]
        assert sorted(mixed.groupby("source").taken.sum()) == sorted(sums.taken) and sorted(mixed.taken) == sorted(got.taken[got.taken > 0])
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = c.execute(f"SELECT target, taken, count(*) FROM ({op4_mix.ORACLE}) GROUP BY ALL ORDER BY ALL").fetchall()
        assert want == sorted((t, n, len(g)) for (t, n), g in got.groupby(["target", "taken"]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>See also</aside><form><input><label>Mail</label></form><section id="comments"><p>First!</p></section><p>Printed on recycled pixels</p><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    marked = "<article><h1>A &amp; B&nbsp;C</h1><p><b>Bold  start.<br><p>Line\n two &lt;3.</p><p>Same line.</p></article>"
    plain = "<div><p>Only here %d.</p><ul><li>one %d<li>two %d</ul></div>"
    rows = [(1, "http://h.com/a/2", PAGE % marked), (2, "http://h.com/a/10", PAGE % marked.replace("Bold", "Other")), (3, "http://g.com/p/1", PAGE % (plain % (1, 1, 1))), (4, "http://g.com/p/2", PAGE % (plain % (2, 2, 2))), (5, "http://g.com/p/3?x", PAGE % (plain % (3, 3, 3))), (6, None, None), (7, "http://lone.org", "<p>Alone &am; text<!-- no --></p>tail"), (7, "http://lone.org", "")]
    got = op8_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    text = {x.page_id: x.text for x in got if x.page_id != 7}
    assert text == {1: "A & B C\nBold start.\nLine two <3.\nSame line.", 2: "A & B C\nOther start.\nLine two <3.\nSame line.", 3: "Only here 1.\none 1\ntwo 1", 4: "Only here 2.\none 2\ntwo 2", 5: "Only here 3.\none 3\ntwo 3", 6: ""}
    assert sorted(x.text for x in got if x.page_id == 7)[1].startswith("Alone &am; text") and all(x.n_chars == len(x.text) for x in got)


def test_leaks(spark):
    r = random.Random(4)
    items = [(k, prose(r, r.choice([15, 40, 59, 150]))) for k in range(40)]
    filler = [prose(r, 1) for _ in range(400)]
    rows = []
    for k, t in items:
        w = t.split()
        near = [x if r.random() > 0.15 else r.choice(filler) for x in w]
        rows += [(k, f"{prose(r, 90, filler)} {t} {prose(r, 30, filler)}"), (100 + k, f"{prose(r, 20, filler)} {' '.join(near)} {prose(r, 70, filler)}"), (200 + k, prose(r, 200, filler)), (300 + k, f"{prose(r, 50, filler)} {' '.join(w[: len(w) // 3])} {prose(r, 50, filler)}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    model = op10_decontaminate.train(docs, bench)
    got = {(x.doc_id, x.item_id) for x in op10_decontaminate.leaks(docs, model).collect()}
    assert {(k, k) for k, _ in items} <= got
    assert len({(100 + k, k) for k, _ in items} & got) >= 38
    long = {(300 + k, k) for k, t in items if len(t.split()) == 150}  # 50 words in a row of an item
    assert long <= got and all(d % 100 == i and d < 200 for d, i in got - long)
    assert {x.doc_id for x in op10_decontaminate.clean(docs, model).collect()} == {d for d, _ in rows} - {d for d, _ in got}


@have_data
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {x.doc_id: x for x in op3_language.identify(docs, op3_language.train(docs)).collect()}
    held = [(got[x.doc_id].lang_pred, x.lang) for x in docs.collect() if got[x.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    got = {x.doc_id: x for x in op9_toxicity.score(docs, op9_toxicity.train(docs, labels)).collect()}
    held = [(got[x.doc_id].predicted, x.toxic) for x in labels.collect() if got[x.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
