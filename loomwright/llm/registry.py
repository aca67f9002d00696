"""Queries of the corpus operators and the SQL that checks those that SQL can express."""

from __future__ import annotations

from loomwright.llm import (
    decontaminate,
    exact_dedup,
    fill_in_middle,
    filter_audit,
    html_text,
    imatch,
    language_id,
    mixing,
    ngram_join,
    ppm,
    quality,
    token_count,
    toxicity,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_html_text": html_text.op3_html_text,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_language_id": language_id.op5_language_id,
    "op6_ppm_scores": ppm.op6_ppm_scores,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_imatch": imatch.op11_imatch,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
