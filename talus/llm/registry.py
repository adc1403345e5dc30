"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, line_dedup, ngram_join, packing, quality, suffix_dedup, toxicity, vector_dedup

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_vector_dedup": vector_dedup.op9_vector_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_suffix_dedup": suffix_dedup.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_vector_dedup": vector_dedup.OP9_SQL,
}
