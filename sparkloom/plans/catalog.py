"""All named queries: importing the modules enters them into the registry."""

from __future__ import annotations

from sparkloom.plans import change_queries, document_queries, enrichment_queries, extraction_queries, index_queries, relational_queries, search_queries, store_queries, stream_queries  # noqa: F401
from sparkloom.plans.registry import ENTRIES, Query


def queries() -> dict[str, Query]:
    return {k: v.run for k, v in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.oracle for k, v in ENTRIES.items() if v.oracle}
