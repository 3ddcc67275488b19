from sparkloom.operators import fulltext


def test_postings_are_shuffled_once(spark, monkeypatch):
    """One exchange of postings besides the count of terms; rows of a doc_id are one document."""
    monkeypatch.setattr(fulltext, "TEXTS", 2)
    rows = [(1, "B a b É a1"), (2, None), (None, "a"), (3, "a a"), (3, "c a"), (4, "")]
    found = fulltext.postings(spark.createDataFrame(rows, "doc_id long, text string"), 8, 1)
    got = sorted((x.term, x.doc_id, x.positions) for x in found.collect())
    assert got == [("a", 1, [1]), ("a", 3, [0, 1, 1]), ("a1", 1, [3]), ("b", 1, [0, 2]), ("c", 3, [0])]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 0
