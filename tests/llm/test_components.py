"""Components of links: few rounds where the links lie in few partitions, whatever the ids."""

import numpy as np

from treeline.llm import components as C


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    ids = np.random.default_rng(2).permutation(300).astype(np.int64)
    ids[7], ids[8] = -(1 << 63), (1 << 63) - 1
    rounds = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: rounds.append(name) or written(df, name))
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:], strict=True)], "a long, b long")
    assert {(r.v, r.root) for r in C.components(links).collect()} == {(int(x), -(1 << 63)) for x in ids}
    assert len(rounds) <= 4  # before: 9


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 3)
    links = spark.createDataFrame([(k, k + 5) for k in range(50)] + [(7, 7)], "a long, b long")
    assert {(r.v, r.root) for r in C.components(links).collect()} == {(k, k % 5) for k in range(55)}


def test_rounds_and_one_task_agree(spark, monkeypatch):
    r = np.random.default_rng(5)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(-400, 400, (500, 2))], "a long, b long")
    jobs = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: jobs.append(name) or written(df, name))
    whole = {(x.v, x.root) for x in C.components(links).collect()}
    assert len(jobs) == 1  # before: a table for each round, six shuffles a round
    monkeypatch.setattr(C, "TASK_ROWS", 3)
    assert {(x.v, x.root) for x in C.components(links).collect()} == whole
    assert len(jobs) > 2


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == []
