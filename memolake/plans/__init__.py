"""Registered queries and their SQL."""

from __future__ import annotations


def _parts() -> list:
    from memolake.plans import analytics, bridging, facts, measures, notebook, notes, requests, retrieval

    return [retrieval, analytics, facts, notes, notebook, measures, bridging, requests]


def queries() -> dict:
    return {k: f for part in _parts() for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _parts() for k, s in part.SQL.items()}
