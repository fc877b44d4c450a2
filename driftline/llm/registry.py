"""Queries of the training-data operators."""

from __future__ import annotations

from driftline.llm import exact_dedup, html_text, language_id, licenses, mixing, near_dedup, packing, quality, sharding, url_filter

_OPS = {
    "op1_mixing": mixing,
    "op2_language_id": language_id,
    "op3_url_filter": url_filter,
    "op4_sharding": sharding,
    "op5_quality": quality,
    "op6_exact_dedup": exact_dedup,
    "op7_near_dedup": near_dedup,
    "op8_packing": packing,
    "op9_licenses": licenses,
    "op10_html_text": html_text,
}


def queries() -> dict:
    return {name: m.query for name, m in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in _OPS.items() if getattr(m, "ORACLE_SQL", None)}
