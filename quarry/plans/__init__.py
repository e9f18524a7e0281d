"""Registered queries and their SQL."""

from __future__ import annotations

from . import candidates, contacts, documents, evidence, listings, merges, opportunities, pages, people, records, texts, urls, views

FLAGSHIP = "opportunities"
_ALL = [documents, people, views, contacts, records, urls, texts, pages, candidates, evidence, merges, listings, opportunities]


def queries() -> dict:
    return {name: query for module in _ALL for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _ALL for name, (_, sql) in module.QUERIES.items() if sql}
