import random

from sparkloom.llm import mixing as M

r = random.Random(9)
WORDS = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(200)]
SCHEMA = "doc_id long, text string, rate string, tokens int"


def text(domain):
    words = [r.choice(WORDS) for _ in range(r.randint(30, 120))]
    if domain == 1:
        words = [w + "%%%" for w in words]
    if domain == 2:
        words[5:5] = ["moron", "idiot"]
    return " ".join(words)


def tables(spark):
    kinds = [0 if r.random() < 0.7 else r.choice([1, 2]) for _ in range(900)]
    rows = [(i, text(k)) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*rows, (5000, None), (5001, ""), (None, "some words here"), (3, rows[3][1])]], SCHEMA)
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    return rows, kinds, docs, labels


def test_rates_meet_the_targets(spark):
    rows, kinds, docs, labels = tables(spark)
    got = M.rates(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(g.rate >= 0 and abs(g.p_good + g.p_plain + g.p_toxic - 1) < 1e-9 for g in got)
    total = {d: sum(g.tokens * g[f"p_{d}"] for g in got) for d in M.DOMAINS}
    mixed = {d: sum(g.rate * g.tokens * g[f"p_{d}"] for g in got) for d in M.DOMAINS}
    budget = 1.1 * total["good"] / 0.88
    want = {"good": 1.1 * total["good"], "plain": min(total["plain"], 0.1 * budget), "toxic": min(total["toxic"], 0.02 * budget)}
    assert all(abs(mixed[d] - want[d]) < 1e-4 * sum(want.values()) for d in M.DOMAINS)
    right = sum(max(M.DOMAINS, key=lambda d: g[f"p_{d}"]) == M.DOMAINS[kinds[g.doc_id]] for g in got if g.doc_id is not None and g.doc_id < 900)
    assert right > 870
    assert all(g.copies in (int(g.rate), int(g.rate) + 1) for g in got)
    assert {g.tokens for g in got if g.doc_id in (5000, 5001)} == {0}


def test_mixed_documents(spark):
    rows, kinds, docs, labels = tables(spark)
    copies = sorted((str(g.doc_id), g.copies) for g in M.rates(docs, labels).collect() if g.copies)
    out = M.mixed(docs, labels)
    assert out.columns == docs.columns
    counts = {}
    for row in out.collect():
        counts[str(row.doc_id)] = counts.get(str(row.doc_id), 0) + 1
    want = {}
    for d, n in copies:
        want[d] = want.get(d, 0) + n
    assert counts == want
    assert all(counts.get(str(i), 0) >= 1 for i, k in enumerate(kinds) if k == 0)


def test_solve():
    x, y = M.solve([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0])
    assert abs(x - 0.8) < 1e-6 and abs(y - 1.4) < 1e-6


def test_projection(spark):
    """A target of nothing takes the rates of its documents to zero, and mixed documents part of the way."""
    rows = [(100, 1.0, 0.0, 0.0)] * 20 + [(100, 0.0, 0.0, 1.0)] * 5 + [(50, 0.6, 0.0, 0.4)] * 4
    scored = spark.createDataFrame(rows, "tokens long, p_good double, p_plain double, p_toxic double")
    steps = M.fit_rates(scored, {"good": 0.98, "plain": 0.01, "toxic": 0.01}, 1.0)
    got = scored.withColumn("rate", M.rate_column([M.F.col(f"p_{d}") for d in M.DOMAINS], steps)).collect()
    toxic = sum(g.rate * g.tokens * g.p_toxic for g in got)
    assert abs(toxic - 0.01 * (2000 + 120) / 0.98) < 0.1 and min(g.rate for g in got) >= 0
    assert len(steps) > 1
    again = M.rates_of([[g.p_good, g.p_plain, g.p_toxic] for g in got], steps)
    assert all(abs(g.rate - x) < 1e-9 for g, x in zip(got, again, strict=True))


def test_empty(spark):
    _, _, docs, labels = tables(spark)
    assert M.rates(docs.limit(0), labels).collect() == []
    assert {round(g.rate, 6) for g in M.rates(docs, labels.limit(0)).collect()}
    assert M.mixed(docs.limit(0), labels.limit(0)).collect() == []


def test_against_plain_least_squares(spark):
    """The same problem by many small projected steps over single documents, in plain Python."""
    rng = random.Random(2)
    docs = []
    for _ in range(60):
        p = [rng.random() ** 3 for _ in range(3)]
        docs.append((rng.randint(5, 200), *(x / sum(p) for x in p)))
    shares = {"good": 0.7, "plain": 0.2, "toxic": 0.1}
    steps = M.fit_rates(spark.createDataFrame([(t, *p) for t, *p in docs], "tokens long, p_good double, p_plain double, p_toxic double"), shares, 1.0)
    now = [sum(t * p[k] for t, *p in docs) for k in range(3)]
    budget = now[0] / shares["good"]
    targets = [now[0], *(min(x, shares[d] * budget) for x, d in zip(now[1:], M.DOMAINS[1:]))]
    miss = lambda rates: [g - sum(r * t * p[k] for r, (t, *p) in zip(rates, docs)) for k, g in enumerate(targets)]
    rates = [1.0] * len(docs)
    length = 1 / sum(t * t * sum(x * x for x in p) for t, *p in docs)
    for _ in range(20_000):
        gap = miss(rates)
        rates = [max(0.0, r + length * t * sum(g * x for g, x in zip(gap, p))) for r, (t, *p) in zip(rates, docs)]
    size = lambda m: sum(x * x for x in m) ** 0.5 / sum(targets)
    ours = M.rates_of([list(p) for _, *p in docs], steps)
    assert size(miss(ours)) <= size(miss(rates)) + 1e-3


def test_very_long_text(spark):
    _, _, docs, labels = tables(spark)
    long = spark.createDataFrame([(7000, "word and " * 200_000, "x", 1)], SCHEMA)
    got = {g.doc_id: g for g in M.rates(docs.unionByName(long), labels).collect()}
    assert got[7000].tokens == 400_000 and got[7000].rate >= 0
