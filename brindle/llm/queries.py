"""The registered queries of the corpus operators."""

from __future__ import annotations

from brindle.llm import fill_middle, language_id, line_dedup, mixing, ngram_join, packing, phrases, quality_classifier, quality_rules, substring_dedup, token_files, url_filter, vector_graph

OPERATORS = {
    "op1_quality_rules": (quality_rules.op1_quality_rules, None),
    "op4_mixing": (mixing.op4_mixing, None),
    "op10_packing": (packing.op10_packing, None),
    "op9_token_files": (token_files.op9_token_files, None),
    "op2_line_dedup": (line_dedup.op2_line_dedup, None),
    "op8_quality_classifier": (quality_classifier.op8_quality_classifier, None),
    "op5_language_id": (language_id.op5_language_id, None),
    "op7_ngram_join": (ngram_join.op7_ngram_join, ngram_join.ORACLE),
    "op6_vector_graph": (vector_graph.op6_vector_graph, None),
    "op3_url_filter": (url_filter.op3_url_filter, url_filter.ORACLE),
    "op11_phrases": (phrases.op11_phrases, phrases.ORACLE),
    "op12_substring_dedup": (substring_dedup.op12_substring_dedup, substring_dedup.ORACLE),
    "op13_fill_middle": (fill_middle.op13_fill_middle, fill_middle.ORACLE),
}


def queries() -> dict:
    return {k: f for k, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in OPERATORS.items() if s is not None}
