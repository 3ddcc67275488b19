import random

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import extraction
from sparkloom.sources import readers, sinks

r = random.Random(21)


def plain_crumbs(rows):
    crumbs, out = [], []
    for kind, level, text in rows:
        if kind == "header":
            crumbs = [*crumbs[: max(1, min(level, 6)) - 1], text]
        out.append(list(crumbs))
    return out


def test_breadcrumbs_equal_the_plain_fold(spark):
    docs = {d: [("header" if r.random() < 0.5 else "text", r.choice([0, 1, 2, 3, 4, 5, 6, 9]), f"t{i}") for i in range(r.randint(0, 40))] for d in range(30)}
    rows = [(d, i, k, n, x, "own") for d, own in docs.items() for i, (k, n, x) in enumerate(own)]
    got = {(x.doc_id, x.seq): x.breadcrumbs for x in extraction.with_breadcrumbs(spark.createDataFrame(rows, "doc_id long, seq int, type string, level int, text string, place string").repartition(5)).collect()}
    assert got == {(d, i): c for d, own in docs.items() for i, c in enumerate(plain_crumbs(own))}


SIGNS = "abc  \t\n é è ß ¼ ½ ¨ ´ “ ” ‘ – — • … € ™ Å Ω ﬁ ① ½ é ñ ̧ 漢 字 한 ᄒ ᅡ ᆫ 😀 \x85 \xa0   　 → ≠ ≠ ⅷ ㎏ ﷺ İ ı \x1c \x1f"


def test_signs_are_mapped_as_in_python(spark):
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [chr(c) + "x" for c in range(0x80, 0x3500, 3)] + [None, "", " \t "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.transport_safe(F.col("t")).alias("a"), T.prompt_clean(F.col("t")).alias("b")).collect()
    for x in got:
        assert (x.a, x.b) == (T.for_transport(texts[x.i]), T.clean_prompt(texts[x.i])), ascii(texts[x.i])


def test_named_files_are_written_by_the_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/pages/page_{i}.md", f"text {i} é".encode()) for i in range(40)], "name string, content binary").repartition(4)
    sinks.write_named_files(rows, f"file://{tmp_path}/out")
    pages = readers.read_markdown_pages(spark, f"file://{tmp_path}/out").collect()
    assert {(p.doc, p.page, p.text) for p in pages} == {(f"d{i % 3}", i, f"text {i} é") for i in range(40)}
