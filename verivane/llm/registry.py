"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from verivane.llm import audio, brown_lm, decontaminate, dedup, hard_negatives, html_extract, license_scan, nearest, packing, pii, quality, url_filter, whitening

MODULES = [quality, packing, dedup, html_extract, brown_lm, url_filter, decontaminate, audio, license_scan, pii, whitening, hard_negatives, nearest]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
