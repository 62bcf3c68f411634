"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from kinspark.llm import (
    best_fit_packing,
    check_sql,
    language_id,
    lexical_search,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    source_mixing,
    spelling_variants,
    substring_dedup,
    suffix_dedup,
    top_k_search,
    vector_packing,
    warc,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_source_mixing": source_mixing.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_top_k_search": top_k_search.query,
    "op5_language_id": language_id.query,
    "op6_ngram_jaccard": ngram_jaccard.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_best_fit_packing": best_fit_packing.query,
    "op9_quality_rules": quality_rules.query,
    "op10_warc": warc.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_lexical_search": lexical_search.query,
    "op13_vector_packing": vector_packing.query,
}

ORACLE_SQL: dict[str, str] = check_sql.ORACLE_SQL
