import json
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sparkloom.operators import graph, mutations
from sparkloom.sources import batch_store
from sparkloom.streaming import cdc

ITEM = "request_id int, k int, op string, expects string, holds boolean, name string, n int"


def test_transactions_are_whole_or_nothing(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, name string, n int")
    items = [
        (1, 1, "update", "exists", True, None, 9), (1, 9, "put", "absent", None, "new", 1),  # accepted
        (2, 2, "delete", None, None, None, None), (2, 3, "check", "exists", False, None, None),  # the check fails
        (3, 3, "update", None, True, "c2", None), (3, 2, "put", "absent", None, "x", 0),  # 2 is there
        (4, 1, "delete", None, None, None, None),  # request 1 writes 1
        (5, 7, "update", None, None, "y", None),  # no such row
        (6, 3, "put", None, None, "z", 5), (6, 3, "check", None, None, None, None),  # named twice
        (7, 3, "check", "exists", None, None, None),  # nothing to write; but 3 is written by request 3
        (8, 8, "check", "absent", None, None, None),
    ]
    after, outcomes = mutations.transacted(table, spark.createDataFrame(items, ITEM), "k")
    assert {x.request_id: x.reason for x in outcomes.collect()} == {1: None, 2: "condition fails", 3: "row exists", 4: "conflict", 5: "no such row", 6: "key named twice", 7: "conflict", 8: None}
    assert sorted(map(tuple, after.collect())) == [(1, "a", 9), (2, "b", 20), (3, "c", 30), (9, "new", 1)]
    none = spark.createDataFrame([], ITEM)
    after, outcomes = mutations.transacted(table, none, "k")
    assert after.count() == 3 and outcomes.isEmpty()


def test_batches_of_25_and_a_key_once_a_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(i % 120, f"v{i} é") for i in range(150)], "k int, v string")
    batch_store.write(rows.coalesce(1), path, "k", 1)
    log = batch_store.commits(spark, path).agg(F.sum("requests"), F.sum("batches")).first()
    assert log[0] == 150 and log[1] >= 6
    got = {x.key: json.loads(x.item) for x in batch_store.read(spark, path).collect()}
    assert set(got) == {str(k) for k in range(120)} and all(v["k"] == int(k) for k, v in got.items())
    gone = spark.createDataFrame([(k, True) for k in range(0, 120, 2)], "k int, __delete boolean")
    batch_store.write(gone, path, "k", 2)
    assert {x.key for x in batch_store.read(spark, path).collect()} == {str(k) for k in range(1, 120, 2)}
    batch_store.write(rows.where("k = 4").limit(1), path, "k", 3)
    assert batch_store.read(spark, path).where("key = '4'").count() == 1


class Picky(batch_store.FolderClient):
    """Leaves every third request of a batch unprocessed at first."""

    def send(self, batch):
        later = [r for i, r in enumerate(batch) if i % 3 == 2 and r["key"] not in self.__dict__.setdefault("known", set())]
        self.known |= {r["key"] for r in later}
        super().send([r for r in batch if r not in later])
        return later


class Deaf(batch_store.FolderClient):
    def send(self, batch):
        return batch


def test_unprocessed_requests_are_sent_again(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(200).selectExpr("id AS k", "'x' AS v")
    batch_store.write(rows, path, "k", 1, client="tests.test_changes:Picky", wait="0.001")
    assert batch_store.read(spark, path).count() == 200
    with pytest.raises(PythonException, match="not processed"):
        batch_store.write(rows, str(tmp_path / "none"), "k", 1, client="tests.test_changes:Deaf", wait="0.001")
    assert not os.path.exists(tmp_path / "none" / "commits")


def test_what_a_failed_write_sent_does_not_count(spark, tmp_path):
    """A file of requests that no commit names is what a task that failed leaves."""
    path = str(tmp_path / "store")
    batch_store.write(spark.range(3).selectExpr("id AS k"), path, "k", 1)
    with open(f"{path}/requests/9-stray.jsonl", "w") as f:
        f.write('{"key": "77", "delete": false, "item": "{}"}\n')
    assert {x.key for x in batch_store.read(spark, path).collect()} == {"0", "1", "2"}


TAGGED = [
    {"S": 'quoted " and\nnew'}, {"N": "1.50"}, {"BOOL": True}, {"NULL": True}, {"M": {}}, {"L": []}, {"SS": ["b", "a", "b"]}, {"NS": ["10", "9.5", "10.0"]},
    {"M": {"z": {"L": [{"S": "x"}, {"M": {"q": {"NULL": True}}}]}, "a": {"N": "2"}}}, {"X": 1}, {"S": "a", "N": "1"}, [1, 2], 5,
]


def test_nested_values_equal_the_plain_ones(spark):
    rows = spark.createDataFrame([(json.dumps(t),) for t in TAGGED] + [("no json",), (None,)], "j string")
    got = [r[0] for r in rows.select(cdc.nested_value(F.col("j"), 3)).collect()]
    assert got[-2:] == [None, None]
    for text, tagged in zip(got, TAGGED):
        want = cdc.plain_value(tagged)
        assert json.loads(text) == json.loads(json.dumps(want, default=float)), tagged
    deep = {"L": [{"L": [{"L": [{"S": "deep"}]}]}]}
    shallow = spark.createDataFrame([(json.dumps(deep),)], "j string").select(cdc.nested_value(F.col("j"), 1)).first()[0]
    assert json.loads(shallow) == [{"L": [{"L": [{"S": "deep"}]}]}] or json.loads(shallow) == [[{"L": [{"S": "deep"}]}]]


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), graph.NODE)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), graph.EDGE)


def test_merges_touch_their_partitions_only_and_repeat(spark, tmp_path):
    kept = graph.KeptGraph(spark, str(tmp_path), 16)
    assert kept.nodes().isEmpty() and kept.edges().isEmpty()
    kept.merge(nodes(spark, *[("N", str(i), {"v": "1"}) for i in range(40)]), edges(spark, ("1", "R", "2"), ("1", "R", "2"), ("2", "R", "3")))
    before = {n: os.listdir(tmp_path / "nodes" / n) for n in os.listdir(tmp_path / "nodes") if "=" in n}
    for _ in range(2):
        kept.merge(nodes(spark, ("N", "7", {"v": "2"}), ("M", "7", {})), edges(spark, ("2", "R", "3"), ("3", "R", "1")))
    after = {n: os.listdir(tmp_path / "nodes" / n) for n in os.listdir(tmp_path / "nodes") if "=" in n}
    assert sum(before.get(n) != after[n] for n in after) <= 2
    got = {(x.label, x.key): x.props for x in kept.nodes().collect()}
    assert len(got) == 41 and got["N", "7"] == {"v": "2"} and got["N", "8"] == {"v": "1"}
    assert sorted(map(tuple, kept.edges().collect())) == [("1", "R", "2"), ("2", "R", "3"), ("3", "R", "1")]


def test_patterns_with_directions_and_a_name_twice(spark):
    n = nodes(spark, *[("P", k, {}) for k in "abc"], ("Q", "x", {}), ("P", "x", {}))
    e = edges(spark, ("a", "K", "b"), ("b", "K", "c"), ("c", "K", "a"), ("a", "L", "x"), ("b", "L", "x"), ("b", "K", "a"))
    ways = lambda *a: sorted(tuple(r) for r in graph.match(n, e, *a).collect())
    assert ways(("p", "P"), ("L", ">", "q", "Q"), ("L", "<", "r", "P")) == [("a", "x", "a"), ("a", "x", "b"), ("b", "x", "a"), ("b", "x", "b")]
    assert ways(("p", "P"), ("K", ">", "q", "P"), ("K", ">", "p", "P")) == [("a", "b"), ("b", "a")]
    assert ways(("p", "Q")) == [("x",)] and ways(("p", "Z"), ("K", ">", "q", "P")) == []


def test_reached_rows_and_cycles(spark):
    table = spark.createDataFrame([(i, i // 2) for i in range(2, 600)], "k long, p long")
    roots = spark.createDataFrame([(1, None, 1)], "k long, p long, level int")
    got = graph.reached(roots, table, "k", "p", "level")
    assert got.count() == 599 and got.agg(F.max("level")).first()[0] == 10
    cycle = spark.createDataFrame([(2, 1), (1, 2)], "k long, p long")
    with pytest.raises(ValueError, match="cycle"):
        graph.reached(roots, cycle, "k", "p", "level", most=5)


def test_studies_without_sections(spark):
    raw = ['{"protocolSection": {"identificationModule": {"nctId": "N1"}}}', "{}", "[]", "no", None, '{"protocolSection": 5, "derivedSection": {"conditionBrowseModule": {"meshes": [{"term": ""}, {"term": "t"}, 7]}}}']
    got = graph.parse_trials(spark.createDataFrame([(x,) for x in raw], "json string")).collect()
    assert len(got) == 3 and [x.trial.nctId for x in got] == ["N1", None, None] and [x.mesh_terms for x in got] == [[], [], ["t"]]
    assert all(x.locations == [] and x.patient_population.stdAges == [] for x in got)
