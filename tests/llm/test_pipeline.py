"""The pipeline over planted rows, stage by stage, against what plain Python expects."""

import random

import duckdb

import corpus_pipeline
from treeline.llm import op4_mix

PARTS = {"en": "ar en il os un tra mi", "de": "che ost ung ber ver ich", "xx": "ski prz owa czy dzi nie"}


def prose(r, lang, n):
    parts = PARTS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(2, 5))) for _ in range(n))


def test_each_stage_drops_what_was_planted_for_it(spark, tmp_path):
    r = random.Random(21)
    lang = lambda k: ["en", "de"][k % 2]
    rows = {k: (prose(r, lang(k), r.randint(40, 90)), lang(k)) for k in range(300)}
    foreign = {1000 + k: (prose(r, "xx", 50), None) for k in range(10)}
    junk = {1100: ("xqzvk jwpqx zzkqj vvxqw kqzjx", None), 1101: ("!!! 123", None), 1102: (None, None), 1103: ("人人生而自由，在尊严和权利上一律平等。", None)}
    near = {1200 + k: (rows[k][0] + " " + prose(r, lang(k), 1), lang(k)) for k in range(10)}
    items = [(k, prose(r, "en", 30)) for k in range(8)]
    leaked = {1300 + k: (f"{prose(r, 'en', 30)} {t} {prose(r, 'en', 30)}", None) for k, t in items}
    secret = {1400 + k: (f"{prose(r, 'en', 30)} AKIA{''.join(r.choices('ABCDEFGHJK234567', k=16))} {prose(r, 'en', 30)}", None) for k in range(8)}
    texts = rows | foreign | junk | near | leaked | secret
    table = [(k, t, v, f"s{k % 3}", len(t or "")) for k, (t, v) in texts.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = set(texts)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], (set(foreign) | set(junk), set(near), set(leaked), set()), strict=True):
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs, left = spark.read.parquet(path), left - gone
        assert {x.doc_id for x in docs.collect()} == left, name
    for x in docs.collect():
        want = texts[x.doc_id][0]
        if x.doc_id in secret:
            want = " ".join("[SECRET]" if w.startswith("AKIA") else w for w in want.split(" "))
        assert (x.text, x.n_chars) == (want, len(want))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {(d, size, taken) for d, size, taken in c.execute(f"SELECT doc_id, size, taken FROM ({op4_mix.ORACLE}) WHERE taken > 0").fetchall()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.doc_id, x["size"], x.taken) for x in got} == want


def test_no_documents(spark, tmp_path):
    """Every stage of an empty table is empty and has its columns."""
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, size int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a few words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
