"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quern.llm import decontamination, html_extraction, importance, line_dedup, line_quality, near_dedup, pii_surrogates, quality_rules, sentencepiece_codec, substring_dedup, token_store, warc, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_token_store": token_store.op9_token_store,
    "op10_pii_surrogates": pii_surrogates.op10_pii_surrogates,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_line_quality": line_quality.op12_line_quality,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op3_warc": warc.SQL,
    "op11_importance_resampling": importance.SQL,
}
