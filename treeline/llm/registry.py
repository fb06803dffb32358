"""The queries of the corpus operators, one per operator, and their oracles."""

from __future__ import annotations

from treeline.llm import op1_substrings, op10_decontaminate, op11_runs, op12_negatives, op13_neighbours, op2_secrets, op3_language, op4_mix, op5_fingerprint, op6_join, op7_quality, op8_html, op9_toxicity

OPERATORS = (op1_substrings, op2_secrets, op3_language, op4_mix, op5_fingerprint, op6_join, op7_quality, op8_html, op9_toxicity, op10_decontaminate, op11_runs, op12_negatives, op13_neighbours)
QUERIES = {m.NAME: m.query for m in OPERATORS}
ORACLES = {m.NAME: m.ORACLE for m in OPERATORS if hasattr(m, "ORACLE")}

#: Columns of queries above that SQL can express, as queries of their own.
PARTS = {"secret_counts": op2_secrets.base_counts, "edited_texts": op5_fingerprint.edited_texts}
PART_ORACLES = {"secret_counts": op2_secrets.COUNTS_SQL, "edited_texts": op5_fingerprint.EDITED_SQL}
