"""Operators of a training-data pipeline over whole corpora."""

from __future__ import annotations

from . import ann, decontaminate, html_extract, importance, langid, packing, pii, secrets, simhash, substring_dedup

MODULES = (langid, substring_dedup, html_extract, ann, decontaminate, packing, secrets, pii, simhash, importance)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
