import random
import zlib

import numpy as np

from sparkloom.llm import quality as Q

r = random.Random(3)
WORDS = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(500)]
SCHEMA = "doc_id long, text string, quality int, score string"


def text(good):
    words = [r.choice(WORDS) for _ in range(r.randint(20, 200))]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + r.choice(["!!", "%%%", " |"]) for w in words)


def test_word_hashes_and_chunks(monkeypatch):
    texts = ["The  cat\tthe", "", "cat", "é x" * 300, "nospace" * 200]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, of = Q.word_hashes(raw, off)
    plain = [w for t in texts for w in t.encode().lower().split()]
    assert len(words) == len(plain) and of.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert all((words[i] == words[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(0, len(plain), 7))
    whole = Q.features(raw, off)
    monkeypatch.setattr(Q, "CHUNK", 1500)
    assert np.allclose(Q.features(raw, off), whole)


def test_held_out_accuracy(spark):
    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t, _ in rows] + [(900, None, 1, ""), (901, "", 1, ""), (None, "some words", 1, ""), (None, "some words", 1, "")], SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 0), (None, 1, 0), (5, rows[5][2], 0)], "doc_id long, quality int, text int").where(~Q.held_out())
    model = Q.fit(docs, labels, max_labelled=300)
    assert len(model.labels) == 300
    got = Q.scores(docs, model, keep=("quality",)).collect()
    assert len(got) == 604 and all(0 <= g.score <= 1 and g.quality is not None for g in got)
    by = {g.doc_id: g.score for g in got}
    held = [(by[i] >= 0.3, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert by[900] == by[901] == model.prior


def test_scores_do_not_depend_on_batches():
    texts = [text(i % 3 > 0) for i in range(60)]
    parts = [Q.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    assert np.allclose(np.concatenate(parts), Q.features(raw, np.cumsum([0, *(len(t.encode()) for t in texts)])))


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.scores(docs, Q.fit(docs, none)).first().score == 0.5
    assert Q.scores(docs.limit(0), Q.fit(docs.limit(0), none)).collect() == []


def test_texts_without_white_space_do_not_depend_on_batches(monkeypatch):
    r.seed(8)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(r.randint(1, 700))) for _ in range(40)] + ["x" * 5000, "ab " + "y" * 900, "", "z"]
    codes = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    alone = [Q.features(c, np.array([0, len(c)])) for c in codes]
    off = np.cumsum([0, *map(len, codes)])
    for chunk in (64, 999, 1 << 18):
        monkeypatch.setattr(Q, "CHUNK", chunk)
        assert np.allclose(Q.features(np.concatenate(codes), off), np.concatenate(alone))


def test_against_plain_voting():
    rows = Q.features(*_joined([text(i % 3 > 0) for i in range(80)]))
    labels = np.array([float(i % 3 > 0) for i in range(80)])
    model = Q.Model(rows[:60], labels[:60], neighbours=7)
    vectors, others = model.project(rows[:60]).astype(float), model.project(rows[60:]).astype(float)
    for v, got in zip(others, model.score(rows[60:]), strict=True):
        near = sorted(((float(sum(a * b for a, b in zip(v, w, strict=True))), y) for w, y in zip(vectors, labels[:60], strict=True)), reverse=True)[:7]
        votes = [(np.exp(model.sharp * (s - 1)) if s > 0 else 0.0, y) for s, y in near]
        assert abs(got - (sum(w * y for w, y in votes) + 1e-6 * model.prior) / (sum(w for w, _ in votes) + 1e-6)) < 1e-4


def _joined(texts):
    codes = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(codes), np.cumsum([0, *map(len, codes)])


def test_several_texts_of_one_id(spark):
    rows = [(1, "AAA!! BBB%%%", 0, ""), (1, "plain words here", 0, ""), (2, "other plain words", 1, "")]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    models = [Q.fit(spark.createDataFrame(x, SCHEMA), labels) for x in (rows, rows[::-1])]
    assert len(models[0].labels) == 2 and np.allclose(models[0].vectors, models[1].vectors)
