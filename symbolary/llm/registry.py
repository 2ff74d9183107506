"""The registered queries of this subpackage."""

from __future__ import annotations

from symbolary.llm import chat_quotes, decontamination, html_text, license_scan, minhash_dedup, quality_qda, sentencepiece_chunks, substring_dedup, topk_tput, url_reputation

_MODULES = (url_reputation, html_text, license_scan, minhash_dedup, topk_tput, decontamination, sentencepiece_chunks, quality_qda, chat_quotes, substring_dedup)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
