"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from umbra.llm import op1_url_trust, op2_byte_bpe, op3_toxicity, op4_near_dedup, op5_decontamination, op6_webp, op7_quality, op8_licenses, op9_sharding, op10_html_text

QUERIES = {
    "op1_url_trust": op1_url_trust.query,
    "op2_byte_bpe": op2_byte_bpe.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_near_dedup": op4_near_dedup.query,
    "op5_decontamination": op5_decontamination.query,
    "op6_webp": op6_webp.query,
    "op7_quality": op7_quality.query,
    "op8_licenses": op8_licenses.query,
    "op9_sharding": op9_sharding.query,
    "op10_html_text": op10_html_text.query,
}
ORACLES: dict[str, str] = {
    "op4_near_dedup": op4_near_dedup.ORACLE,
    "op10_html_text": op10_html_text.ORACLE,
}
