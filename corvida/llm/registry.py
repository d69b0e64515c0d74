"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corvida.llm.jaccard_join import op8_jaccard_join
from corvida.llm.license_scan import op6_license_scan
from corvida.llm.lm_score import op3_lm_score
from corvida.llm.packing import op10_packing
from corvida.llm.quality_rules import op2_quality_rules
from corvida.llm.secret_scan import op9_secret_scan
from corvida.llm.source_mix import OP7_SQL, op7_source_mix
from corvida.llm.substring_dedup import op1_substring_dedup
from corvida.llm.token_counts import op4_token_counts
from corvida.llm.topk_search import op5_exact_topk

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_lm_score, op4_token_counts, op5_exact_topk, op6_license_scan, op7_source_mix, op8_jaccard_join, op9_secret_scan, op10_packing)}
ORACLES: dict[str, str] = {"op7_source_mix": OP7_SQL}
