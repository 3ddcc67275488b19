import random
import re

import numpy as np
import pytest

from sparkloom.operators import fulltext, hnsw, search

r = random.Random(5)
SCHEMA = "vec_id long, embedding array<float>, node long, shard int"


def vectors(n, width=24, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, width))
    return centres[g.integers(0, 12, n)] + 0.6 * g.normal(size=(n, width))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), 1, 1) for i, v in enumerate(x)], SCHEMA)


def recall(spark, index, df, **how):
    asked = df.where("vec_id % 20 = 0").select(df.vec_id.alias("query_id"), "embedding")
    found = {(q, v) for q, v in hnsw.search(asked, index, 10, **how).select("query_id", "vec_id").collect()}
    wanted = {(q, v) for q, v in search.search_all(asked, df, 10).select("query_id", "vec_id").collect()}
    return len(found & wanted) / len(wanted)


@pytest.fixture(scope="module")
def built(spark):
    df = frame(spark, vectors(3000)).cache()
    return df, hnsw.build(df, shard=1100).cache()


def test_recall_over_shards(spark, built):
    df, index = built
    assert index.select("shard").distinct().count() == 3 and recall(spark, index, df) >= 0.95


def test_neighbour_lists_are_bounded_and_point_into_their_layer(built):
    rows = built[1].collect()
    own = {}
    for x in rows:
        own.setdefault((x.shard, x.layer), set()).add(x.node)
    assert max(x.layer for x in rows) >= 2 and {x.node for x in rows if x.layer == 0} == set(range(3000))
    for x in rows:
        assert len(x.neighbours) <= (32 if x.layer == 0 else 16) and len(set(x.neighbours)) == len(x.neighbours)
        assert set(x.neighbours) <= own[x.shard, x.layer] - {x.node} and (x.embedding is not None) == (x.layer == 0)


def test_a_written_index_in_any_order(spark, built, tmp_path):
    built[1].repartition(7, "node").write.parquet(str(tmp_path / "index"))
    again = spark.read.schema(hnsw.INDEX).parquet(str(tmp_path / "index"))
    asked = frame(spark, vectors(5, seed=9)).selectExpr("vec_id AS query_id", "embedding")
    rows = [sorted(map(tuple, hnsw.search(asked, i, 4).collect())) for i in (built[1], again)]
    assert rows[0] == rows[1] and len(rows[0]) == 20


def test_inserted_vectors_are_found_and_replaced_ones_gone(spark, built):
    df, index = built
    more = frame(spark, vectors(300, seed=4), 2900)
    both = df.where("vec_id < 2900").unionByName(more)
    found = hnsw.inserted(index, more, shard=1100).cache()
    assert found.where("layer = 0").count() == 3200 and found.where("layer = 0").select("node").distinct().count() == 3200
    assert recall(spark, found, both) >= 0.95


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [1.0, 0.1])]
    df = spark.createDataFrame([(*x, 1, 1) for x in rows], SCHEMA)
    found = hnsw.search(df.where("vec_id = 1").limit(1).selectExpr("vec_id AS query_id", "embedding"), hnsw.build(df), 5)
    assert [x.vec_id for x in found.orderBy("rank").collect()] == [1, 4, 2]
    none = spark.createDataFrame([], SCHEMA)
    assert hnsw.build(none).collect() == [] and hnsw.search(none.selectExpr("vec_id AS query_id", "embedding"), hnsw.build(df), 5).collect() == []
    assert hnsw.search(df.limit(1).selectExpr("vec_id AS query_id", "embedding"), hnsw.build(none), 5).collect() == []


WORDS = ["one", "two", "three", "Four", "the", "the", "the"]
TEXTS = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", "...", "ÉTÉ the,two", "the-two THE_TWO"]


def plain_terms(text):
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def written_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "index")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "the one", "x", 1)], "doc_id long, text string, term string, bucket int")
    fulltext.write(df, path, buckets=8, slice_rows=30)
    return fulltext.Index(spark, path, 8)


def counts(text, phrase):
    t, p = plain_terms(text), plain_terms(phrase)
    return sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else 0


def test_all_and_any(written_index):
    for words in (["the"], ["one", "four"], ["one", "two", "three", "four"], ["absent", "the"], []):
        tokens = [plain_terms(t) for t in TEXTS]
        every = {i: sum(t.count(w) for w in set(words)) for i, t in enumerate(tokens) if words and set(words) <= set(t)}
        some = {i: sum(t.count(w) for w in set(words)) for i, t in enumerate(tokens) if set(words) & set(t)}
        assert {x.doc_id: x.hits for x in written_index.all_of(words).collect()} == every
        assert {x.doc_id: x.hits for x in written_index.any_of(words).collect()} == some


def test_phrases(spark, written_index):
    phrases = ["the two", "the the", "one two three", "four", "THE, two!", "", "absent the", "the the the the"]
    got = {(x.query_id, x.doc_id): x.hits for x in written_index.phrases(spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")).collect()}
    assert got == {(q, i): n for q, p in enumerate(phrases) for i, t in enumerate(TEXTS) if (n := counts(t, p))}


def test_only_the_terms_partitions_are_read(written_index):
    plan = written_index.of(["one"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [In(term, [one])]" in plan.replace("EqualTo(term,one)", "In(term, [one])").replace("IsNotNull(term), ", "")


def test_common_terms_lie_in_slices(written_index):
    slices = {x.term: x.n for x in written_index.rows.groupBy("term").agg({"slice": "max"}).withColumnRenamed("max(slice)", "n").collect()}
    assert slices["the"] >= 3
