"""Steps that must grow no faster than their input: how work is dealt out, and what is held at once."""

import gc

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions import html
from sparkloom.sources import readers, sinks
from sparkloom.streaming import documents


def test_a_single_row_group_is_parsed_by_several_tasks(spark, tmp_path):
    """One file with one row group: pages are dealt out before they are parsed."""
    spark.range(0, 20000, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<form action='"), F.sha2(F.col("id").cast("string"), 512), F.lit("'></form>")).alias("html")).write.parquet(f"{tmp_path}/pages")
    found = html.page_forms(spark.read.parquet(f"{tmp_path}/pages"))
    assert found.select(F.spark_partition_id()).distinct().count() > 1 and found.count() == 20000


def test_a_parsed_tree_goes_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        before = len(gc.get_objects())
        for _ in range(50):
            assert len(html.links(html.parse("<div><p>a<p>b<a href='x'>t</a><ul><li>1<li>2</ul></div>" * 20), "http://h/")) == 20
        assert len(gc.get_objects()) - before < 2000
    finally:
        gc.enable()


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of the files: their plan has no file scan."""
    rows = spark.range(600).selectExpr("concat('doc_', id div 4, '/tables/t ', id, '.csv') as name", "concat('a,b\n', id, ',\"x, \"\"', id, '\"\"\"\n\n', id, ',é%20\n') as content").coalesce(1)
    sinks.write_named_files(rows, f"file://{tmp_path}/out it")
    (tmp_path / "out it/doc_1/tables/_hidden.csv").write_text("a,b\n7,7\n")
    (tmp_path / "out it/doc_2/tables/none.txt").write_text("a,b\n7,7\n")
    (tmp_path / "out it/other").mkdir()
    found = readers.read_csv_files(spark, f"{tmp_path}/out it", "doc_*/tables/*.csv", "a long, b string")
    assert sorted(map(tuple, found.collect())) == sorted(x for i in range(600) for x in ((i, f'x, "{i}"'), (i, "é%20")))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_by_tasks_at_each_level(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('d', id div 5, '/pages/page_', id % 5, '.md') as name", "concat('t', id) as content")
    sinks.write_named_files(rows, str(tmp_path / "in"))
    deep = readers.read_markdown_pages(spark, str(tmp_path / "in"))
    assert {(x.doc, x.page, x.text) for x in deep.collect()} == {(f"d{i // 5}", i % 5, f"t{i}") for i in range(50)}
    assert "FileScan" not in deep._jdf.queryExecution().executedPlan().toString()
    assert readers.read_markdown_pages(spark, str(tmp_path / "in/d1")).count() == 5
    assert {x.doc for x in readers.read_markdown_pages(spark, str(tmp_path / "in/d1/pages"), natural=False).collect()} == {"d1"}
    assert readers.read_markdown_pages(spark, str(tmp_path / "absent")).count() == 0


class Handle:
    """A document's state and timers, with the calls that are made to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):
        self.calls.append("list")
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_document_asks_its_store_at_most_four_times_a_batch():
    life, handle, n = documents.Life(10), Handle(), []
    life.init(handle)

    def batch(*changes):
        handle.calls.clear()
        rows = pd.DataFrame(changes, columns=["us", "change_id", "change"]).assign(stage=None)
        n.extend(x for out in life.handleInputRows(("d",), iter([rows]), None) for x in zip(out["change"], out["accepted"], out["status"], strict=True))
        return len(handle.calls), sorted(handle.timers)

    assert batch((2_000_001, 2, "claimed"), (2_000_001, 1, "created")) == (3, [12001])
    assert batch((3_000_000, 3, "completed")) == (4, [13000])
    assert batch((3_000_000, 4, "retry")) == (2, [13000])
    assert batch((14_000_000, 5, "failed")) == (3, [])
    assert n == [("created", True, "PENDING"), ("claimed", True, "IN_PROGRESS"), ("completed", True, "COMPLETED"), ("retry", False, "COMPLETED"), ("expired", True, None), ("failed", False, None)]
