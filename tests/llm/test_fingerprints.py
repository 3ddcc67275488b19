import hashlib
import random

from sparkloom.llm import fingerprints as P

SCHEMA = "doc_id long, text string, fingerprint string, range int"


def make(n, seed=5):
    r = random.Random(seed)
    words = [("".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(2, 9)))) for _ in range(4000)]
    return [(i * 3, " ".join(r.choice(words) for _ in range(r.randint(0, 400)))) for i in range(n)]


def test_edited_texts_and_likeness(spark):
    rows = make(90)
    rows += [(1000, None), (1001, ""), (1002, "é"), (1003, "x" * 5000), (1004, rows[4][1]), (1005, " ".join(rows[i][1] for i in range(60))), (None, rows[4][1]), (1006, rows[8][1]), (1006, rows[8][1])]
    df = spark.createDataFrame([(d, t, "f", 1) for d, t in rows], SCHEMA).repartition(5)
    got = P.edited_fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256) for g in got), key=str) == sorted(want, key=str)
    by = {g.doc_id: g for g in got}
    assert by[12].fingerprint == by[1004].fingerprint == by[None].fingerprint
    assert by[1000].fingerprint == by[1001].fingerprint == "0" * 256 and by[1000].near_next == 1
    long = [g for g in got if g.n_chars > 600 and g.doc_id and g.doc_id < 1000]
    assert all(0 <= x <= 1 for g in got for x in (g.near_edited, g.near_next))
    assert sum(g.near_edited for g in long) / len(long) > 0.35 and max(g.near_next for g in long) < 0.2
    assert {g.doc_id: g.fingerprint for g in P.fingerprints(df).collect()} == {g.doc_id: g.fingerprint for g in got}


def test_likeness_falls_with_edits():
    walks, r = P.Walks(), random.Random(1)
    text = make(3, 8)[1][1] * 3 + make(4, 9)[3][1] * 3
    near = []
    for edits in (0, 2, 10, 60, 400):
        t = list(text)
        for _ in range(edits):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], ["q"], [t[i], "z"]])
        a, b = P.sketch([text, "".join(t)], walks)
        near.append(float(P.likeness(a, b)))
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.85 and near[4] < 0.4


def test_near_pairs(spark):
    base = make(40, 2)
    rows = [(d, t) for d, t in base if len(t) > 500]
    copies = [(d + 1, t[:200] + "Z" + t[200:]) for d, t in rows[:10]] + [(5000 + d, t) for d, t in rows[:3]]
    prints = P.fingerprints(spark.createDataFrame(rows + copies, "doc_id long, text string"))
    pairs = {(x.a, x.b) for x in P.near_pairs(prints, 0.7).collect()}
    assert pairs == {(d, d + 1) for d, _ in rows[:10]}


def test_one_and_none(spark):
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = P.edited_fingerprints(spark.createDataFrame([(1, "abcd", "", 1)], SCHEMA)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_every_character_is_read():
    walks, r = P.Walks(), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    for n in (1, 8, 31, 33, 51, 52, 80):
        for _ in range(60):
            a = "".join(r.choice(letters) for _ in range(n))
            pairs.append((a, a[: max(0, n - 10)] + "".join(r.choice(letters.replace(c, "")) for c in a[-10:])))
    before, after = P.sketch([a for a, _ in pairs], walks), P.sketch([b for _, b in pairs], walks)
    assert (before != after).any(1).all()


def test_each_change_of_one_character_is_read():
    walks, r = P.Walks(), random.Random(7)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (20, 51, 70, 100)]
    for t in texts:
        prints = P.sketch([t] + [t[:i] + "#" + t[i + 1 :] for i in range(len(t))], walks)
        assert (prints[1:] != prints[0]).any(1).all()
