import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import html as H
from sparkloom.operators import evaluation as E
from sparkloom.operators import graph as G
from sparkloom.operators import mutations as M
from sparkloom.operators import search as S
from sparkloom.sources import readers as R
from sparkloom.sources import sinks as W
from sparkloom.streaming import cdc

HTML = """<html><head><title>T <b>x</b></title><meta name="description" content="d"></head><body><nav><a href="/a">A</a><a href="http://o.org/"></a></nav>
<main><h1>Head</h1><p>one<p>two &amp; three<script>var p="</p>";</script><ul><li>i<ul><li>inner</li></ul></li><li>j</li></ul><img src="p.png" alt="pic"><pre> code </pre></main>
<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td></tr></table><form action="/go"><input name="q"><select name="s"></select></form><video src="v.mp4"></video></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://x.org/p", HTML), (2, "http://x.org/", None)], "page_id long, url string, html string")
    links = H.page_links(pages).collect()
    assert [(x.url, x.text, x.is_internal) for x in links] == [("http://x.org/a", "A", True), ("http://o.org/", "[No text]", False)]
    blocks = [(b.type, b.content) for b in H.page_blocks(pages).collect()]
    assert blocks == [("heading1", "Head"), ("paragraph", "one"), ("paragraph", "two & three"), ("list", "i inner\nj"), ("image", "pic http://x.org/p.png"), ("code", "code")]
    (table,) = H.page_tables(pages).collect()
    assert table.header == ["h1", "h2"] and table.rows == [["h1", "h2"], ["1", ""]]
    assert H.page_forms(pages).first().fields == ["input:text:q", "select:select:s"] and {m.kind for m in H.page_media(pages).collect()} == {"img", "video"}
    assert H.report(pages).where("page_id = 1").first().markdown.startswith("# T x\n\nSource: http://x.org/p\n\n## Content\n\n# Head")


def test_mutations(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (4, "z", 1)], "k int, v string, at int")
    put = M.upsert(table.withColumn("at", F.lit(0)), new, ["k"], F.col("at")).orderBy("k").collect()
    assert [(r.k, r.v) for r in put] == [(1, "a"), (2, "y"), (3, None), (4, "z")]
    kept = M.insert_new(table.withColumn("at", F.lit(0)), new, ["k"], F.col("at")).orderBy("k").collect()
    assert [(r.k, r.v) for r in kept] == [(1, "a"), (2, "b"), (3, None), (4, "z")]
    assert [r.v for r in M.update_fields(table, new.where("at = 1"), "k", ["v"]).orderBy("k").collect()] == ["a", "x", None]
    assert M.delete(table, new, ["k"]).count() == 2
    states = spark.createDataFrame([("d1", "PENDING", None), ("d2", "FAILED", None)], "document_id string, status string, owner string")
    claims = spark.createDataFrame([("d1", "w2"), ("d1", "w1"), ("d2", "w1")], "document_id string, owner string")
    assert [tuple(r) for r in M.claim(states, claims, "document_id").orderBy("document_id").collect()] == [("d1", "IN_PROGRESS", "w1"), ("d2", "FAILED", None)]


def test_search(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    near = unit @ unit.T
    want = {(q, int(v)) for q in range(0, 400, 20) for v in np.lexsort((np.arange(400), -near[q].round(12)))[:5]}
    exact = {(g.query_id, g.vec_id) for g in S.search_all(asked, vectors, 5).collect()}
    assert len(exact & want) >= 99
    centres = S.fit_centroids(vectors, 8)
    found = {(g.query_id, g.vec_id) for g in S.search_index(asked, S.with_lists(vectors, centres), centres, 5, 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert S.top_k(vectors, [0.0] * 16, 2).collect()[0].score == 0
    with pytest.raises(ValueError, match="dimensions"):
        S.check_dimensions(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))


def test_cache_and_rows(spark):
    rows = spark.createDataFrame([("n", "q1", "a" * 9000, [1.0, 0.0]), ("n", "q2", "", [0.0, 1.0])], "namespace string, question string, answer string, embedding array<double>")
    cache = S.cache_entry(rows, F.lit(100))
    (hit,) = S.cache_lookup(cache, [1.0, 0.1], "n", F.lit(200)).collect()
    assert hit.question == "q1" and len(hit.answer) == 8000
    assert not S.cache_lookup(cache, [0.0, 1.0], "n", F.lit(200)).collect() and not S.cache_lookup(cache, [1.0, 0.0], "n", F.lit(3700)).collect()
    chunks = spark.createDataFrame([(None, "", "text", None, "para", None, ["k"] * 12, [1.0]), ("i", None, "t", "x", None, "s3", None, [])], "id string, chunk_id string, content string, type string, chunk_type string, s3_uri string, key_phrases array<string>, embedding array<double>")
    (v,) = S.vector_rows(chunks).collect()
    assert v.id.startswith("chunk_") and v.type == "para" and v.key_phrases.count("k") == 10
    sized = spark.createDataFrame([("x" * 4000,)], "t string").select(F.length(S.compact_metadata(F.col("t"), 2500)).alias("n")).first()
    assert sized.n == 2000
    hits = spark.createDataFrame([("Tables", "t", "text", 0.5), ("Tables", "u", "more", 0.9)], "kind string, name string, text string, score double")
    assert S.context_text(hits).first().context == "## Tables\n- u (score:0.900): more\n- t (score:0.500): text"


def test_metrics(spark):
    row = spark.createDataFrame([(["a", "b", "a"], ["a", "z"])], "r array<string>, w array<string>").select(E.retrieval_metrics(F.col("r"), F.col("w"), 3).alias("m")).first().m
    assert (row.precision, row.recall, row.f1, row.hit_rate) == (0.6667, 1.0, 0.8, 1.0) and row.ndcg == round((1 + 0.5) / (1 + 1 / np.log2(3)), 4)
    qa = spark.createDataFrame([(1, "The cat, the cat!", "the cat sat"), (2, "", "x"), (3, "Same.", "same")], "k int, a string, r string")
    assert {x.k: x.token_f1 for x in E.token_f1(qa, "k", "a", "r").collect()} == {1: 0.5714, 2: 0.0, 3: 1.0}
    assert [x.m for x in qa.orderBy("k").select(E.exact_match(F.col("a"), F.col("r")).alias("m")).collect()] == [0, 0, 1]
    judged = spark.createDataFrame([("0.7",), ("3",), ("bad",), (None,)], "s string").select(E.judge_score(F.col("s")).alias("x")).collect()
    assert [j.x for j in judged] == [0.7, 1.0, 0.0, 0.0]


def test_graph(spark):
    record = {"id": "N1", "title": "t", "conditions": [" Flu ", ""], "drugs": [{"name": "D", "type": "x"}, {"name": "D", "type": "x"}], "sponsor": {"name": "S"}, "sites": [{"name": "A", "country": "C"}, {"name": "B", "country": " "}], "outcomes": [{"measure": "m"}, {"measure": "m"}], "population": {"sex": "ALL"}, "mesh": ["M"]}
    records = G.parse_records(spark.createDataFrame([(json.dumps(record),), ("{bad",), (json.dumps({"id": "N2"}),)], "json string"))
    nodes, edges = G.nodes(records), {tuple(e) for e in G.edges(records).collect()}
    counts = {c.label: c.n for c in G.label_counts(nodes).collect()}
    assert counts == {"Trial": 2, "TrialCategory": 2, "Disease": 1, "Drug": 1, "Sponsor": 1, "Site": 2, "Country": 1, "MeSHTerm": 1, "Outcome": 2, "PatientPopulation": 1}
    assert ("N2", "BELONGS_TO", "Unknown") in edges and ("N1", "LOCATED_AT", "A") in edges and ("N1", "LOCATED_AT", "B") not in edges
    assert not G.duplicate_keys(nodes).collect()


def test_changes_and_wire_values(spark):
    assert cdc.plain_value({"M": {"a": {"N": "1.5"}, "b": {"L": [{"S": "x"}, {"NULL": True}]}, "c": {"SS": ["b", "a", "a"]}, "d": {"ZZ": 1}}}) == {"a": Decimal("1.5"), "b": ["x", None], "c": ["a", "b"], "d": {"ZZ": 1}}
    rows = spark.createDataFrame([({"a": "1", "b": "2", "g": "9"}, {"a": "1", "b": "3", "n": None, "m": "5"}), ({}, {"a": "1"}), (None, {"a": "1"})], "old map<string,string>, new map<string,string>")
    got = [r.c for r in rows.select(cdc.changes(F.col("old"), F.col("new")).alias("c")).collect()]
    assert {k: tuple(v) for k, v in got[0].items()} == {"b": ("2", "3"), "g": ("9", None), "m": (None, "5")} and not got[1] and not got[2]


def test_upload_files(spark, tmp_path):
    header = ",".join(R.UPLOAD_COLUMNS)
    base = "V1,Name,Cat,,desc,S1,B,9.5,,3.9,ea,,,\n"
    lines = [base, base.replace("V1", "V2"), "V3,,Cat,,d,S3,B,1,,0,ea,,,\n", "V4,N,Old,,d,S4,B,1,,1,ea,,,\n", "V5,N,Cat,,d,S5,B,-1,,1,ea,,,\n", f"V6,{'n' * 201},Cat,,{'d' * 150},S6,B,1,,1,ea,,,\n", "V7,N,Cat,,d,S7,B,abc,,1,ea,,,\n"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/VEND001_20260104.csv").write_text(header + "\n" + "".join(lines))
    rows = R.read_vendor_csv(spark, f"{tmp_path}/in")
    first = rows.orderBy("row_number").first()
    assert (first.vendor_id, first.upload_id, first.record_id, first.stock_quantity, first.price) == ("VEND001", "UPLOAD_20260104", "REC_00001", 3, 9.5)
    categories = spark.createDataFrame([("Cat", True), ("Old", False)], "category_name string, is_active boolean")
    products = spark.createDataFrame([], "vendor_id string, vendor_product_id string, sku string")
    judged = cdc.validated(rows, categories, products).orderBy("row_number")
    assert [j.error_type for j in judged.collect()] == [None, "DUPLICATE_SKU", "MISSING_REQUIRED_FIELDS", "INVALID_CATEGORY", "INVALID_PRICE", "FIELD_TOO_LONG", "MISSING_REQUIRED_FIELDS"]
    assert judged.collect()[2].error_message == "Missing required fields: product_name, stock_quantity"
    cdc.write_error_files(judged, f"{tmp_path}/errors")
    back = spark.read.option("header", True).csv(f"{tmp_path}/errors")
    assert back.count() == 6 and max(len(r.description or "") for r in back.collect()) == 100


def test_readers(spark, tmp_path):
    pages = tmp_path / "d/pages"
    pages.mkdir(parents=True)
    for n in (2, 10):
        (pages / f"page_{n}.md").write_text(f"p{n}")
    (tmp_path / "latin.txt").write_bytes("café".encode("latin-1"))
    got = R.read_markdown_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(g.doc, g.page, g.text) for g in got] == [("d", 2, "p2"), ("d", 10, "p10")]
    assert R.read_texts(spark, f"{tmp_path}/latin.txt").first().text == "café"
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [{"id": "3"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    assert sorted(c.id for c in R.read_chunk_json(spark, f"{tmp_path}/*.json", "id string").collect()) == ["1", "2", "3"]
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert R.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id string").count() == 2
    (tmp_path / "conf").write_text("a = b=c\nnone\n")
    assert [tuple(r) for r in R.read_settings(spark, f"{tmp_path}/conf").collect()] == [("a", "b=c")]
    with pytest.raises(ValueError, match="delete"):
        R.read_only_sql(spark, "DELETE FROM t")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("n", "1", "old", [1.0], 1), ("n", "2", "b", [2.0], 1)], "namespace string, id string, content string, embedding array<double>, created_at int")
    new = spark.createDataFrame([("n", "1", "new", [3.0], 2)], rows.schema)
    W.write_vectors(rows, f"{tmp_path}/v")
    W.upsert_vectors(spark.read.parquet(f"{tmp_path}/v").select(*rows.columns), new, f"{tmp_path}/w")
    assert {(r.id, r.content) for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {("1", "new"), ("2", "b")}
    skipped = W.with_skips(spark.createDataFrame([(" ", [1.0]), ("AI description unavailable x", [1.0]), ("ok", [1.0])], "content string, embedding array<double>"))
    assert [s.skipped_reason for s in skipped.collect()] == ["empty content", "placeholder", None]
    assert tuple(W.embedding_summary(skipped, 20.0).first())[:3] == (3, 1, 2)
    control = W.control_rows(spark.createDataFrame([("d",)], "document_id string"), F.lit(100))
    after = W.with_stage(control, "extract", "FAILED", F.lit(True), F.lit(200))
    row = after.first()
    assert row.status == "FAILED" and row.stage_status["extract"] == "FAILED" and row.stage_status["load"] == "PENDING" and row.ttl == 100 + 90 * 86400
    assert W.audit_rows(control, after, F.lit(200)).first().old_status == "PENDING"
