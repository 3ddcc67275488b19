import numpy as np

from sparkloom.operators import search


def test_lists_are_met_in_parts(spark, monkeypatch):
    """Parts of lists and of their queries: no row for a query and a vector that aren't among the nearest, same results."""
    monkeypatch.setattr(search, "HELD", 40)
    monkeypatch.setattr(search, "ASKING", 7)
    monkeypatch.setattr(search, "SCORES", 100)
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding")
    centres = search.fit_centroids(vectors, 4)
    found = search.search_index(asked, search.with_lists(vectors, centres), centres, 6, 4)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(q, v, r + 1) for q in range(0, 300, 5) for r, v in enumerate(np.argsort(-(unit @ unit[q]), kind="stable")[:6].tolist())}
    assert {(g.query_id, g.vec_id, g["rank"]) for g in found.collect()} == want
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()
