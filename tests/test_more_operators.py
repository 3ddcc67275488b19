import json

from pyspark.sql import functions as F

from sparkloom.operators import enrichment as N
from sparkloom.operators import extraction as X
from sparkloom.operators import store as S


def one(spark, value, schema, f):
    return spark.createDataFrame([(value,)], f"x {schema}").select(f(F.col("x")).alias("y")).first()["y"]


def test_phrases_and_entities(spark):
    phrases = [("a", 0.95), ("b", 0.5), ("c", 0.99)]
    assert one(spark, phrases, "array<struct<text:string,score:double>>", lambda c: N.key_phrases(c, 2)) == ["c", "a"]
    rows = [(1, 0, "ORG", "Acme", 0.5), (1, 1, "ORG", "acme", 0.9), (1, 2, "ORG", "Beta", 0.4), (1, 3, "ORG", "Cut", 1.0), (1, 0, "DATE", "May", 0.3)]
    got = N.organised_entities(spark.createDataFrame(rows, "chunk_id long, seq int, type string, text string, confidence double"), 3).first().entities
    assert [tuple(e) for e in got["ORG"]] == [("Acme", 0.9), ("Beta", 0.4)] and [tuple(e) for e in got["DATE"]] == [("May", 0.3)]


def test_spans_and_answers(spark):
    df = spark.createDataFrame([("Ann é mailed Bob", [(0, 3, "NAME"), (13, 16, "NAME")])], "t string, s array<struct<start:int,end:int,type:string>>")
    assert df.select(N.redact_spans(F.col("t"), F.col("s")).alias("y")).first().y == "[REDACTED_NAME] é mailed [REDACTED_NAME]"
    raw = '```json\n[{"key_phrases": ["a", "b"], "entities": {"ORG": ["x"]}, "redacted_text": "first"}, {"key_phrases": ["b"], "entities": {"ORG": ["y", "x"], "LOC": ["z"]}, "redacted_text": ""}]\n```'
    got = one(spark, raw, "string", N.model_answer)
    assert got.redacted_text == "first" and got.key_phrases == ["a", "b"] and got.entities == {"LOC": ["z"], "ORG": ["x", "y"]}
    assert one(spark, '{"redacted_text": "t"}', "string", N.model_answer).redacted_text == "t" and one(spark, "not json", "string", N.model_answer) is None


def test_messages(spark):
    got = one(spark, "It is so.\nEPISODIC: yes", "string", N.episodic_decision)
    assert got.store and got.answer == "It is so." and not one(spark, "plain", "string", N.episodic_decision).store
    assert one(spark, ["aa", "b", "cc"], "array<string>", N.longest_word) == "cc"
    assert not one(spark, [1, 2], "array<int>", N.chart_spec).ok and one(spark, [1, 2, 3], "array<int>", N.chart_spec).ok
    chunks = spark.createDataFrame([(1, "Ada Lovelace met Bob"), (2, " ")], "chunk_id long, content string")
    assert [r.entities for r in N.enriched(chunks).orderBy("chunk_id").collect()] == [{"NAME": ["Ada Lovelace", "Bob"]}, None]
    assert N.enriched(chunks, lambda t: {"N": [str(len(t))]}).orderBy("chunk_id").first().entities == {"N": ["20"]}


def test_tables_and_code(spark):
    table = "| a | b |  |\n|---|:--|--|\n| 1 |  | x |\n| nan | 2 | y |"
    assert one(spark, table, "string", X.cell_dump) == "a: 1\nb: 2"
    assert one(spark, table, "string", lambda c: X.table_body(c, 10)).is_large == "yes" and one(spark, table, "string", X.table_body).body == table
    assert one(spark, "def f(): pass", "string", X.code_block) == "```python\ndef f(): pass\n```" and one(spark, "{ a; }", "string", X.code_block) == "```\n{ a; }\n```" and one(spark, "A plain sentence.", "string", X.code_block) is None
    pages = spark.createDataFrame([(1, 1, "x\n|a|b|\n|1|2|\ny\n|c|d|"), (1, 2, "|e|f|")], "doc_id long, page int, text string")
    assert [(t.page, t.table_no, t.table) for t in X.table_runs(pages).orderBy("table_no").collect()] == [(1, 1, "|a|b|\n|1|2|"), (1, 2, "|c|d|"), (2, 3, "|e|f|")]
    assert one(spark, "y" * 600, "string", X.clamp_description).endswith("...") and one(spark, "y", "string", X.clamp_description) is None


def test_items(spark):
    rows = [(1, 0, 1, "header", 1, "A"), (1, 1, 1, "header", 3, "C"), (1, 2, 1, "image", 0, "img"), (1, 3, 1, "text", 0, "Figure 1 shows"), (1, 4, 2, "header", 2, "B"), (1, 5, 2, "text", 0, "t")]
    items = spark.createDataFrame(rows, "doc_id long, seq int, page int, type string, level int, text string")
    assert [r.breadcrumbs for r in X.with_breadcrumbs(items).orderBy("seq").collect()] == [["A"], ["A", "C"], ["A", "C"], ["A", "C"], ["A", "B"], ["A", "B"]]
    assert [r.type for r in X.captions_first(items).orderBy("seq").collect()][2:4] == ["text", "image"]
    assert [r.id for r in X.unique_ids(items).orderBy("seq").collect()] == ["p1_header_1", "p1_header_2", "p1_image_1", "p1_text_1", "p2_header_1", "p2_text_1"]
    assert X.assembled_pages(items.withColumn("output", F.col("text"))).where("page = 2").first().text == "B\n\nt"
    assert one(spark, "T", "string", lambda c: X.element_markdown(F.lit("Title"), c)) == "# T"


def test_store(spark):
    rows = [("u:1", "a", {"kind": "x"}, 1, [1.0, 0.0]), ("u:1", "b", {"kind": "y"}, 2, [0.0, 1.0]), ("u2", "c", {"kind": "x"}, 3, [1.0, 0.0])]
    store = spark.createDataFrame(rows, S.SCHEMA)
    after = S.put(store, spark.createDataFrame([("u:1", "a", {"kind": "z"}, 4, [1.0, 0.0]), ("u2", "c", None, 4, None)], S.SCHEMA))
    assert {(r.namespace, r.key): r.value for r in after.collect()} == {("u:1", "a"): {"kind": "z"}, ("u:1", "b"): {"kind": "y"}}
    assert S.get(store, "u2", "c").count() == 1
    assert [r.key for r in S.search(store, "u", [1.0, 0.1]).collect()] == ["a", "b"] and [r.key for r in S.search(store, "u", None).collect()] == ["b", "a"]
    assert [r.key for r in S.search(store, "u", [1.0, 0.1], where={"kind": {"$in": ["y"]}}).collect()] == ["b"]
    assert [r.key for r in store.where(S.metadata_filter({"ts": {"$gt": 1}, "$or": [{"key": "b"}, {"key": "a"}]})).collect()] == ["b"]
    assert {r.namespace for r in S.namespaces(store, 1).collect()} == {"u", "u2"}
    v = S.stand_in_vector("t", 64)
    assert v == S.stand_in_vector("t", 64) and abs(sum(x * x for x in v) - 1) < 1e-6


def test_golden_rows(spark):
    examples = spark.createDataFrame([(f"e{i}", "q", "a", ["c1", "c2"]) for i in range(4)], "id string, question string, answer string, contexts array<string>")
    golden, corpus = S.golden_and_corpus(examples, 2, 3)
    assert golden.first().context_ids == ["e0_d0", "e0_d1"] and corpus.count() == 6 and corpus.where("in_golden").count() == 4
    assert json.dumps([r.id for r in golden.collect()]) == '["e0", "e1"]'
