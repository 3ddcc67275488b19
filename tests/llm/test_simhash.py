import random

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash as S
from sparkloom.llm.common import Scratch
from sparkloom.llm.graph import components

SCHEMA = "doc_id long, text string, fp string, component_id int, bucket int"


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted(((d, fps[i], min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_against_all_pairs(spark):
    r = random.Random(3)
    words = "Alpha beta x GAMMA delta\tepsilon zeta Éta theta".split(" ")
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i * 2, text(r.randint(0, 90))) for i in range(80)]
    long = text(3000).split(" ")
    for i in range(60):  # near copies of a long text, and copies of copies
        at = r.randrange(len(long))
        long[at : at + 1] = [r.choice(words), str(i)]
        rows.append((1000 - i, " ".join(long)))
    rows += [(5, None), (3, ""), (7, " \n\t"), (None, "alpha beta gamma"), (11, "alpha BETA gamma"), (11, "alpha beta gamma")]
    got = S.near_duplicates(spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)).collect()
    assert sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in got), key=str) == brute(rows)


@pytest.mark.parametrize("lead", [0, 3, 8])
def test_links_connect_what_is_near(spark, lead):
    r = random.Random(lead)
    seeds = [r.getrandbits(64) for _ in range(25)]
    fps = set()
    for s in seeds:
        for _ in range(6):
            fps.add(s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = S.near_links(df, lead)
    roots = {x.node % 2**64: x.root for x in components(links, Scratch(spark, "t")).collect()}
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert all((x.a % 2**64 ^ x.b % 2**64).bit_count() <= 4 for x in links.collect())
    assert all(roots.get(fps[i]) is not None and roots[fps[i]] == roots[fps[j]] for i, j in near)
    assert len(near) > 20


def test_large_buckets_are_split(monkeypatch):
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(400)})
    found = np.array(fps, np.uint64)

    def groups(links):
        at = {x: x for x in fps}

        def find(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in zip(*(x.view(np.uint64).tolist() for x in links), strict=True):
            at[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in fps]

    whole = groups(S.ball_links(found, 0, 0, 2, 4))
    monkeypatch.setattr(S, "STEP_WORDS", 3000)
    assert groups(S.ball_links(found, 0, 0, 2, 4)) == whole
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert len(near) > 50 and all(whole[i] == whole[j] for i, j in near)


def test_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(1000, 1200)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[x] == 100 for x in range(100, 161)) and all(got[x] == 1 for x in range(1000, 1200)) and 7 not in got


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
