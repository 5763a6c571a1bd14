"""The registered queries of the package and their DuckDB statements.  Queries
without a statement are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from . import (decontamination, exact_dedup, filter_audit, language_id, lm_scoring, mixing, near_dedup, ngram_join, quality,
               substring_dedup, token_output, vector_codes, warc)

LLM_QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_language_id": language_id.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_minhash_dedup": near_dedup.op9_minhash_dedup,
    "op10_token_output": token_output.op10_token_output,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

LLM_ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
