"""The registry of named queries, each with the SQL that it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import TABLES, read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def register(oracle: str | None = None, name: str | None = None):
    """Decorator: enters a query under its function's name."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        ENTRIES[key] = Entry(f, oracle)
        return f

    return put


def register_sql(name: str, statement: str, oracle: str | None = None) -> None:
    """Enters a query stated in SQL over the input tables; ``oracle`` where DuckDB needs other words for it."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]
    marked = re.sub(rf"(?<!AS )\b({'|'.join(used)})\b(?!\.)(?=\s|,|\)|$)", r"{\1}", statement)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(marked, **{t: read_table(spark, sf_dir, t) for t in used})

    register(oracle or statement, name)(run)
