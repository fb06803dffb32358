"""Batches of texts are scanned piece by piece."""

import pyarrow as pa

from treeline.llm import op2_secrets as S


def test_pieces_hold_all_rows_in_order_and_little_at_once():
    texts = ["x" * (k % 50) for k in range(2000)] + [None, "y" * 5000, "", "z"]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = list(S.pieces(iter([part, part.slice(0, 0)]), 1000))
    assert [t for p in got for t in p.column("text").to_pylist()] == texts
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in got if p.num_rows > 1) < 7000
    assert max(p.num_rows for p in got) <= 20


def test_the_scan_never_sees_a_whole_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(S, "spans_of", lambda texts, model: seen.append(sum(map(len, texts))) or [[] for _ in texts])
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["w" * 2000] * 5000})
    rows = sum(p.num_rows for p in S.scanner(type("Shared", (), {"value": None}))(iter([part])))
    assert rows == 5000 and max(seen) <= S.AT_ONCE + 2000  # before: all 10,000,000
