import hashlib
import random

import pytest
from pyspark.sql import types as T

from sparkloom.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, ids string, mark int"


def brute(rows, depth=50):
    """Every window of every document in a dictionary of its smallest document."""
    least, out = {}, {}
    texts = [(d if d is not None else float("inf"), (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            least[w] = min(least.get(w, float("inf")), d)
    result = []
    for d, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if least[b[p : p + depth]] < d:
                gone[p : p + depth] = [True] * depth
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        result.append((None if d == float("inf") else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = remove_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gämma", "de", "the", "of", "lorem", "ipsum", "x" * 30, "%%%"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(40), "one common line that many documents carry in the same words, over fifty bytes\n"
    rows = []
    for d in range(60):
        t = text(r.randint(0, 60))
        if d % 3 == 0:
            t += line + text(5)
        if d % 7 == 0:
            a = r.randint(0, 60)
            t = t[: len(t) // 2] + passage[a : a + 49 + r.randint(0, 100)] + t[len(t) // 2 :]
        if d % 11 == 0 and rows:
            t = rows[r.randrange(len(rows))][1] or ""
        rows.append((d * 3 + 1, t))
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 400), (505, "ab" * 200), (506, "a" * 120 + "b")]
    rows += [(507, text(20_000)), (508, rows[3][1]), (508, rows[3][1]), (1, "other text of an id that comes twice " * 4), (None, rows[5][1]), (None, rows[5][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_small_depth_and_gram(spark):
    rows = [(i, "abcabcabd" * (i % 3) + "zzzzq" * (i % 2)) for i in range(12)]
    assert run(spark, rows, depth=9, gram=4) == brute(rows, 9)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).schema["n_removed"].dataType == T.LongType()


def test_runs_of_windows_fit_their_byte(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], SCHEMA), depth=400, gram=24)
    rows = [(i, "x" * 200 + "q" * i + "longer passage in every text " * 14) for i in range(4)]
    assert run(spark, rows, depth=279, gram=24) == brute(rows, 279)


def test_many_parts_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.suffix_dedup.PART_BYTES", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = corpus(3)
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
