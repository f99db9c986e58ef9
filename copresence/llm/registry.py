"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from copresence.llm import (
    decontamination,
    divergence,
    language_id,
    license_scan,
    packing,
    quality_rules,
    resampling,
    sentencepieces,
    simhash,
    spelling,
    suffix_dedup,
    topk_search,
    url_filter,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_language_id": language_id.op3_language_id,
        "op4_exact_topk": topk_search.op4_exact_topk,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_quality_resampling": resampling.op7_quality_resampling,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op4_exact_topk": topk_search.ORACLE_SQL,
        "op5_license_scan": license_scan.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_decontamination": decontamination.ORACLE_SQL,
    }
