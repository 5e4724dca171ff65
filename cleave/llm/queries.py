"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cleave.llm import decontaminate, html_text, language_id, media, minhash, mixing, pii, quality, sharding, url_filter

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_pii": pii.query,
    "op3_html_extraction": html_text.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_decontamination": decontaminate.query,
    "op6_media_columns": media.query,
    "op7_sharding": sharding.query,
    "op8_language_id": language_id.query,
    "op9_mixing": mixing.query,
    "op10_url_filter": url_filter.query,
}
ORACLES = {"op4_minhash_near_dedup": minhash.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op10_url_filter": url_filter.ORACLE}
