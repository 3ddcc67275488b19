import random
import re

import duckdb
import pyarrow as pa

import __spark_entry__ as S
from sparkloom.operators import fulltext

ASKED, TEXTS = 40, 30


def rows_made(node):
    """The rows that came out of each step of a plan that has run."""
    metrics, name = node.metrics(), node.nodeName()
    own = [metrics.apply("numOutputRows").value()] if metrics.contains("numOutputRows") else []
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return own + [n for x in below for n in rows_made(x)]


def test_places_of_common_terms_are_not_rows(spark, tmp_path):
    """What queries with a common term put through the plan doesn't grow with their number times the term's places."""
    texts = [" ".join(["the"] * 200 + [f"w{i % ASKED} the the"]) for i in range(TEXTS)]
    fulltext.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "index"), 8)
    queries = spark.createDataFrame([(q, f"The w{q} the the") for q in range(ASKED)], "query_id long, phrase string")
    found = fulltext.Index(spark, str(tmp_path / "index"), 8).phrases(queries)
    assert sorted(tuple(x) for x in found.collect()) == [(i, i, 1) for i in range(TEXTS)]
    made = rows_made(found._jdf.queryExecution().executedPlan())
    assert TEXTS <= max(made) < 5 * (ASKED + TEXTS)  # the common term's places are met by 40 queries, 3 times each: 720,000


def test_rows_that_share_an_id(spark, tmp_path):
    """Documents and items whose ids are not their own: as the SQL counts them."""
    items = [(1, "one two"), (1, "two three"), (1, "one two"), (2, "the the the the the")]
    docs = [(1, "one two three"), (1, "one two"), (2, "the the the the the"), (2, "the the the the the the"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in S.queries()["indexed_phrases"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert got == sorted(db.sql(S.oracle_sql()["indexed_phrases"]).fetchall()) and len(got) == 7


def test_blocks_of_batches_of_any_size(monkeypatch):
    """Texts cut into blocks by bytes, number and slice, with documents that go on in the next batch."""
    monkeypatch.setattr(fulltext, "SLICE_BYTES", 40)
    monkeypatch.setattr(fulltext, "TEXTS", 3)
    r = random.Random(5)
    rows = sorted((d % 3, d, " ".join(r.choice(["a", "B", "É,cd", "x9", "-"]) for _ in range(r.randint(0, 9)))) for d in [r.randint(0, 25) for _ in range(60)])
    schema = pa.schema([("slice", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary())])
    for step in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_pylist([{"slice": s, "doc_id": d, "text": t.encode()} for s, d, t in rows[k : k + step]], schema) for k in range(0, 60, step)]
        want: dict = {}
        for part, doc, text in rows:
            for n, term in enumerate(re.findall("[a-z0-9]+", text.replace("B", "b"))):
                want.setdefault((part, term, doc), []).append(n)
        made = [row for batch in fulltext._blocks(iter(batches)) for row in batch.to_pylist()]
        got = [((x["slice"], x["term"], d), p) for x in made for d, p in zip(x["doc_ids"], x["positions"], strict=True)]
        assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
