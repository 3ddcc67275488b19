"""Every named query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import catalog
from sparkloom.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        at = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the input tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    if name not in catalog.oracle_sql():
        assert len(df.columns) == len(set(df.columns)) and got
        return
    found = sql.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, found.fetchall())


def test_names_are_the_entry_modules():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[1] / "sparkloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "sparkloom.llm" in p.read_text()]
