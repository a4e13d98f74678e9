"""All queries of the subpackage, with the DuckDB SQL of those that have one."""

from __future__ import annotations

from . import (
    decontaminate_queries,
    html_extract_queries,
    jaccard_join_queries,
    langid_queries,
    licenses_queries,
    manifest_queries,
    mixing_queries,
    neighbours_queries,
    quality_queries,
    resampling_queries,
    sharding_queries,
    simhash_queries,
    warc_queries,
)

_MODULES = [sharding_queries, licenses_queries, jaccard_join_queries, langid_queries, mixing_queries, quality_queries, html_extract_queries, warc_queries, simhash_queries, decontaminate_queries,
            resampling_queries, manifest_queries, neighbours_queries]


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
