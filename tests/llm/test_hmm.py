import math
import random
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from sparkloom.llm import hmm as H

r = random.Random(8)
LANGS = [["".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(80)] for a in ("abcdefg", "mnopqrs")]
SCHEMA = "doc_id long, text string, n_tokens string, score int"


def rows():
    out = [(i, " ".join(r.choice(LANGS[i % 2]) for _ in range(r.randint(0, 150)))) for i in range(300)]
    return out + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "unseen" * 30 + " Zq zq ZQ"), (1004, " ".join(LANGS[0] * 40)), (None, "abc abc"), (3, "twice the id"), (3, "twice the id")]


def tokens(text):
    return [*(text or "").encode().lower().split(), H.END]


def plain_forward(model, symbols):
    """Forward recursion over all state paths, a step at a time."""
    p, log = model.start.copy(), 0.0
    for s in symbols:
        p = (p @ model.move) * model.emit[:, s]
        log += math.log(p.sum())
        p = p / p.sum()
    return log


def a_model(k=3, m=9):
    g = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return H.Model(norm(g.random(k)), norm(g.random((k, k))), norm(g.random((k, m))))


def test_pieces_equal_the_plain_recursion():
    model, g = a_model(), np.random.default_rng(4)
    texts = [g.integers(0, 9, n).astype(np.int32) for n in (1, 2, 31, 32, 33, 64, 65, 700, 5)]
    got = model.log_likelihood(texts)
    assert np.allclose(got, [plain_forward(model, t) for t in texts])


def test_expected_counts_by_enumeration():
    model = a_model(2, 3)
    texts = [np.array(t, np.int32) for t in ([0, 2, 1], [1], [2, 2, 0, 1])]
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for t in texts:
        paths = {}
        for code in range(2 ** (len(t) + 1)):
            path = [code >> i & 1 for i in range(len(t) + 1)]
            p = model.start[path[0]]
            for a, b, s in zip(path, path[1:], t, strict=False):
                p *= model.move[a, b] * model.emit[b, s]
            paths[tuple(path)] = p
        total = sum(paths.values())
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b, s in zip(path, path[1:], t, strict=False):
                moves[a, b] += p / total
                emits[b, s] += p / total
    got = model.expected(texts)
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits)


def test_scores(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA).repartition(3)
    options = {"states": 2, "symbols": 40, "common": 100, "rounds": 6}
    got = H.score(df, ~H.held_out(), **options).collect()
    train = [t for d, t in data if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for d, t in data), key=str)
    assert sorted(((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got), key=str) == want
    held = [g for g in got if g.doc_id is not None and g.doc_id < 300 and zlib.crc32(str(g.doc_id).encode()) % 7 == 2]
    assert all(g.score < 0 for g in got) and sum(g.score for g in held) > sum(g.base_score for g in held)
    assert len({round(g.score, 9) for g in got if g.doc_id in (1000, 1001, 1002)}) == 1


def test_scores_are_those_of_a_distribution(spark):
    """All one-word texts over the training tokens, and the unseen ones as one, with their ends: at most one in sum."""
    data = [(i, " ".join(r.choice("a b c d e f g".split()) for _ in range(20))) for i in range(40)]
    kinds = "a b c d e f g".split()
    tests = [(10_000 + i, w) for i, w in enumerate([*kinds, "unseen"])]
    df = spark.createDataFrame(data + tests, "doc_id long, text string")
    got = {g.doc_id: g.score for g in H.score(df, F.col("doc_id") < 10_000, states=2, symbols=4, common=5, rounds=2).collect()}
    assert 0 < sum(10 ** got[d] for d, _ in tests) < 1


def test_rounds_raise_the_likelihood(spark):
    model = H.begin(H.Lexicon([(b"x", 5), (b"y", 4), (b"z", 2)], 4, 12, 4), 2, 1)
    texts = [(bytes(np.array([i % 2] * 8 + [2, 3] * (i % 3), np.int16)),) for i in range(30)]
    _, seen = H.baum_welch(spark.createDataFrame(texts, "symbols binary"), model, 5)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (got,) = H.score(df, F.lit(False)).collect()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)
    assert H.score(df.limit(0), F.lit(True)).collect() == []
