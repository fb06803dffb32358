"""Every operator over nulls, empty and long texts, repeated rows and clashing columns, and over empty tables."""

import hashlib

import pytest

import corpus_pipeline
from treeline.llm import op1_substrings, op2_secrets, op3_language, op4_mix, op5_fingerprint, op6_join, op7_quality, op8_html, op9_toxicity, op10_decontaminate

NO_SPANS = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, None), (None, 1, 1), (99, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def secrets():
    return op2_secrets.fit(*op2_secrets.windows(op2_secrets.examples([])[:200]), epochs=10)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and"), (2, None), (3, ""), (4, "!!!")], "item_id long, text string")


def test_odd_rows(spark, odd, labels, secrets, benchmark):
    n = odd.count()
    got = op1_substrings.repeats(odd, 8).collect()
    assert {(r.doc_id, tuple(r.first_doc_ids)) for r in got} == {(2, (1,)), (7, (6,))}
    assert op1_substrings.dedup(odd, 8).columns == odd.columns and {r.doc_id: r.text for r in op1_substrings.dedup(odd, 8).collect()}[7] == ""
    got = op2_secrets.scan(odd, secrets).collect()
    assert len(got) == n and {r.base_sha256 for r in got} == {NO_SPANS}
    got = {r.doc_id: r for r in op3_language.identify(odd, op3_language.train(odd)).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5, 10)][:3] == ["und"] * 3 and got[None].held_out and got[7].lang_pred in {"en", "fr", "de"}
    got = op4_mix.mix(odd).collect()
    assert len(got) == n and all(r.taken <= 3 * r["size"] for r in got) and {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert len({r.taken for r in got if r.doc_id == 1}) == 1
    got = op5_fingerprint.fingerprints(odd).collect()
    assert len(got) == n and len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1 and {r.fingerprint for r in got if r.doc_id in (3, 4)} == {"0::"}
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in op6_join.groups(odd).collect()))
    assert len(got) == n and got[:4] == [(0, 5, None), (1, 10, 1), (1, 10, 1), (2, 10, 1)] and {g for g in got if g[0] in (3, 4, 5)} == {(3, 0, 3), (4, 0, 4), (5, 0, 5)}
    assert [g[2] for g in got if g[0] == 7] == [6]
    kept = op6_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 10]
    got = op7_quality.classify(odd, *op7_quality.train(odd)).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    got = op9_toxicity.score(odd, op9_toxicity.train(odd, labels)).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    model = op10_decontaminate.train(odd, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in op10_decontaminate.leaks(odd, model).collect()) == [(1, 1), (2, 1)]
    assert op10_decontaminate.clean(odd, model).count() == n - 3


def test_empty_tables(spark, empty, labels, secrets, benchmark):
    for df in (
        op1_substrings.repeats(empty), op1_substrings.dedup(empty), op2_secrets.scan(empty, secrets), op3_language.identify(empty, op3_language.train(empty)), op4_mix.mix(empty), op4_mix.mixed(empty), op5_fingerprint.fingerprints(empty),
        op6_join.groups(empty), op6_join.one_of_each(empty), op7_quality.classify(empty, *op7_quality.train(empty)), op9_toxicity.score(empty, op9_toxicity.train(empty, labels.limit(0))),
        op10_decontaminate.leaks(empty, op10_decontaminate.train(empty, benchmark)), op10_decontaminate.clean(empty, op10_decontaminate.train(empty, benchmark.limit(0))), op8_html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_pipeline_over_odd_rows(spark, odd, benchmark, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 6, 8, 9, 10} and got
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "redact_secrets", "mix_sources"]
