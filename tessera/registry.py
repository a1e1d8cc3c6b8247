"""All queries of the engine proper, by name, with their oracle SQL."""

from __future__ import annotations

from .plans import ORACLE, QUERIES, answers, corpus, incremental, reports, tokens, tools, workflows  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
