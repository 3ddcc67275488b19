import duckdb

import __spark_entry__ as S


def test_places_of_phrases_within_terms(spark, tmp_path):
    """A phrase may begin within a term or end within one, and its places don't overlap: as the SQL counts them."""
    items = [(1, "Cióníciónez de la"), (2, "a a a a"), (3, "one two"), (4, "in the end of it")]
    docs = [(1, "cióníciónez xció n ci nez de"), (2, "a a a a a a a a a"), (3, "one two; gone twofold, one two"), (4, "In the end of, begin the end often"), (5, "begin the end often"), (6, None), (7, "ci n ci nez xci n ci nezde")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in S.queries()["indexed_phrases"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(db.sql(S.oracle_sql()["indexed_phrases"]).fetchall())
    assert got == want and {(1, 7, 2), (3, 3, 3), (4, 4, 2)} <= set(got)
