"""All registered queries and their SQL oracles."""

from __future__ import annotations

from newswatch.plans import (
    oracle_enrich,
    oracle_load,
    oracle_pages,
    oracle_reporting,
    oracle_streaming,
    queries_enrich,
    queries_load,
    queries_pages,
    queries_reporting,
    queries_streaming,
)

QUERY_MODULES = [queries_reporting, queries_load, queries_enrich, queries_pages, queries_streaming]
ORACLE_MODULES = [oracle_reporting, oracle_load, oracle_enrich, oracle_pages, oracle_streaming]


def queries() -> dict:
    out: dict = {}
    for module in QUERY_MODULES:
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in ORACLE_MODULES:
        out |= module.oracle()
    return out


ARTICLES_PER_SF = 100_000  # rows of the documents table per scale factor
