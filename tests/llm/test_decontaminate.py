import random

import numpy as np

from sparkloom.llm import decontaminate as D

r = random.Random(12)
WORDS = ["".join(r.choice("etaoinshrdlé") for _ in range(r.randint(2, 8))) for _ in range(600)]
SCHEMA = "doc_id long, text string, item_id string, start int"


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, rate):
    out = list(text)
    for i in r.sample(range(len(out)), int(rate * len(out))):
        out[i] = r.choice(["", "x", out[i] + "y"])
    return "".join(out)


def plain_distance(a, b):
    """Least edit distance between a and any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_least_edits():
    for _ in range(200):
        a, b = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(2)]
        got, end = D.least_edits(np.array([ord(c) for c in a]), np.array([ord(c) for c in b]))
        assert got == plain_distance(a, b) and 0 <= end <= len(b)


def test_leaks(spark):
    items = [(i, prose(r.randint(16, 50))) for i in range(40)] + [(90, "too short"), (91, None), (92, "")]
    rows, want, soft = [], set(), set()
    for i in range(300):
        text, item = prose(r.randint(0, 300)), items[i % 40]
        if i < 80:
            text += " " + (item[1] if i % 2 else item[1].upper().replace(" ", "\n")) + " " + prose(20)
            want.add((i, item[0]))
        elif i < 140:
            text = prose(5) + " " + edited(item[1], 0.07) + ", " + text
            soft.add((i, item[0]))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, items[3][1]), (503, " ".join([items[3][1], prose(40), items[3][1]])), (504, items[5][1][: len(items[5][1]) // 2]), (505, prose(30_000) + items[6][1]), (None, items[7][1]), (502, items[3][1])]
    want |= {(502, 3), (503, 3), (505, 6), (None, 7)}
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    leaks = D.Leaks(bench)
    hits = leaks.hits(docs).collect()
    got = {(h.doc_id, h.item_id) for h in hits}
    assert want <= got and got <= want | soft and len(got & soft) >= 0.9 * len(soft)
    assert len([h for h in hits if h.doc_id == 503]) == 2
    text, item = dict(rows), dict(items)
    for h in hits:
        span = " ".join(text[h.doc_id][h.start : h.end].lower().split("\n"))
        assert h.likeness >= 0.8 and abs(plain_distance(item[h.item_id].lower(), span) - h.distance) <= 0
    kept = leaks.without(docs)
    assert kept.columns == docs.columns
    assert sorted(str(k.doc_id) for k in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {g[0] for g in got})
    split = D.Leaks(bench, block_bytes=2000)
    assert len(split.blocks) > 2 and {(h.doc_id, h.item_id) for h in split.hits(docs).collect()} == got


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, prose(50))], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.Leaks(bench).hits(docs).collect() == [] and D.Leaks(bench).without(docs).count() == 1
    assert D.Leaks(spark.createDataFrame([(1, prose(9))], "item_id long, text string")).hits(docs.limit(0)).collect() == []


def far_edits(text, rate):
    out = list(text)
    for _ in range(int(rate * len(text))):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], [r.choice("abcdefgh ")], [r.choice("abcdefgh "), out[i]]])
    return "".join(out)


def test_recall_at_the_stated_likeness(spark):
    items = [(i, prose(15)) for i in range(200)]
    docs = spark.createDataFrame([(i, f"{prose(15)} {far_edits(t, 0.19)} {prose(15)}") for i, t in items], "doc_id long, text string")
    got = {(h.doc_id, h.item_id) for h in D.Leaks(spark.createDataFrame(items, "item_id long, text string")).hits(docs).collect()}
    assert len([i for i, _ in items if (i, i) in got]) >= 0.9 * len(items)


def test_short_items_word_for_word(spark):
    short = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 4))) for _ in range(5)) for _ in range(100)] + ["\u6f22\u5b57\u4eee\u540d\u4ea4"]
    items = list(enumerate(short))
    docs = spark.createDataFrame([(i, f"{prose(15)} {t} {prose(15)}") for i, t in items], "doc_id long, text string")
    got = {(h.doc_id, h.item_id) for h in D.Leaks(spark.createDataFrame(items, "item_id long, text string")).hits(docs).collect()}
    assert {(i, i) for i, _ in items} <= got


def found_by_scan(items, texts, rate=0.2):
    """Which items lie in which texts, by the plain table over all of each text; characters folded as the operator does."""
    fold = lambda t: "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in t).replace("\n", " ")
    return {(i, k) for i, t in enumerate(texts) for k, x in items if plain_distance(fold(x), fold(t)) <= rate * len(x)}


def model(items, least_words=5):
    return D.Items(items, 0.2 + 1e-9, least_words, 15, 2, 23)


def test_against_a_scan_of_all_windows():
    """Every item against every text, at growing edits: nothing false is found, and 0.9 of what is there (all, for items
    under 15 words)."""
    for low, high, least in ((5, 14, 1.0), (15, 20, 0.9)):
        items = [(i, prose(r.randint(low, high))) for i in range(24)]
        texts = [f"{prose(8)} {far_edits(t, rate)} {prose(8)}" for rate in (0.08, 0.12, 0.16, 0.19) for _, t in items[:12]]
        want = found_by_scan(items, texts)
        got = {(f[0], f[1]) for f in model(items).find(texts)}
        assert got <= want and len(got) >= least * len(want) and len(want) >= 45


def test_recall_of_longer_items():
    for low, high in ((15, 15), (16, 30), (31, 60)):
        for rate in (0.08, 0.12, 0.16, 0.19):
            items = [(i, prose(r.randint(low, high))) for i in range(100)]
            got = {(f[0], f[1]) for f in model(items).find([f"{prose(15)} {far_edits(t, rate)} {prose(15)}" for _, t in items])}
            assert len([i for i in range(100) if (i, i) in got]) >= 90, (low, rate)


def test_repetitive_text():
    found = model([(1, "na " * 10), (2, "ha ha")]).find(["na " * 11_000, "ha ha ha " * 3, "aha ha"])
    first = [f for f in found if f[:2] == (0, 1)]
    assert len(first) == 1100 and all(a[3] <= b[2] for a, b in zip(first, first[1:]))
    assert [f[2:4] for f in found if f[0] == 1] == [(0, 5), (6, 11), (12, 17), (18, 23)]
    assert not [f for f in found if f[0] == 2]


def test_few_words_as_they_are():
    items = [(1, "What is the capital?"), (2, "Yes"), (3, "漢字"), (4, "   ")]
    found = model(items).find(["so WHAT is\nthe capital? yes", "what is the capital?s yesterday 大漢字典", "yes"])
    assert [(f[0], f[1], f[4]) for f in found] == [(0, 1, 0), (0, 2, 0), (1, 3, 0), (2, 2, 0)]


def test_segments_and_bounded_proposals(monkeypatch):
    items = [(i, prose(r.randint(2, 40))) for i in range(30)] + [(99, prose(20))] * 2
    items += [(100, items[7][1])]
    texts = [" ".join(prose(30) + " " + items[r.randrange(30)][1] for _ in range(40)) for _ in range(5)]
    whole = model(items).find(texts)
    assert {f[1] for f in whole if f[1] == 7} == {7} and {f[:1] + f[2:] for f in whole if f[1] == 7} == {f[:1] + f[2:] for f in whole if f[1] == 100}
    monkeypatch.setattr(D, "SEGMENT", 1500)
    monkeypatch.setattr(D, "PROPOSALS", 50)
    assert model(items).find(texts) == whole


def test_the_broadcast_is_plain_text():
    import pickle

    items = [(i, prose(20)) for i in range(500)]
    used = model(items)
    used.find(["a text"])
    assert len(pickle.dumps(used)) < 2 * sum(len(t.encode()) for _, t in items)
