"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from citelens.llm import decontamination, html_extraction, language_id, media, mixing, ngram_join, secrets, substring_dedup, token_counts, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_media": media.op8_media,
    "op9_language_id": language_id.op9_language_id,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_secrets": secrets.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_media": media.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
}
