"""Registered queries of the core library and their DuckDB oracles."""

from __future__ import annotations

from . import corpus_queries, operator_queries, pattern_queries, taint_queries, unicode_queries

_MODULES = [unicode_queries, pattern_queries, taint_queries, corpus_queries, operator_queries]


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
