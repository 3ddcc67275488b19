import random

import numpy as np
import pytest

from sparkloom.llm import minhash as M

r = random.Random(13)
WORDS = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(2000)]
SCHEMA = "doc_id long, text string, id string, key int"


def prose(n):
    return [r.choice(WORDS) for _ in range(n)]


def swapped(words, n):
    out = list(words)
    for i in r.sample(range(len(out)), min(n, len(out))):
        out[i] = "changed" + str(r.randrange(10**6))
    return out


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain(rows):
    """All pairs of rows, linked as the contract says."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    named = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d is None, d or 0), len(s), c if c is not None else -1, d == c) for (d, _), s, c in zip(rows, sets, named))


def got(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted(((x.doc_id is None, x.doc_id or 0), x.n_shingles, x.component_id if x.component_id is not None else -1, x.kept) for x in M.near_duplicates(df, **how).collect())


def families():
    rows, n = [], 0
    for _ in range(50):
        base = prose(r.randint(5, 250))
        for _ in range(r.randint(1, 6)):
            rows.append((n, " ".join(swapped(base, r.randint(0, 2 + len(base) // 15)))))
            n += 1
    rows += [(900, None), (901, ""), (902, " \t "), (903, "two words"), (904, "TWO  words"), (905, "one"), (906, "One"), (907, "Ünï words é"), (None, "no id here at all"), (None, "NO id here at all"), (None, ""), (3, rows[0][1]), (3, rows[0][1]), (908, rows[5][1])]
    # exactly 80 percent, and just under: 8 of 10 and 7 of 9 shingles
    rows += [(910, "a b c d e f g h i j"), (911, "a b c d e f g h i x"), (912, "q w e r t y u i o"), (913, "q w e r t y u i p"), (914, "k l m n k l m n k l m n"), (915, "k l m n")]
    return rows


def test_against_all_pairs(spark):
    rows = families()
    assert got(spark, rows) == plain(rows)


def test_a_large_family_whose_members_are_near_some_others_only(spark, monkeypatch):
    """Members change many words of one base, so pairs lie on both sides of the limit; small chunks and parts."""
    monkeypatch.setattr(M, "QUERIES", 20)
    monkeypatch.setattr(M, "HELD", 50)
    base = prose(150)
    rows = [(i, " ".join(swapped(base, r.randint(4, 14)))) for i in range(400)]
    want = plain(rows)
    assert 5 < len({x[2] for x in want}) < 395
    assert got(spark, rows) == want


@pytest.mark.parametrize("size", [1, 2, 5, 30, 300, 3000])
def test_bins_agree_by_similarity(size):
    """Densified bins agree as often as the sets are alike, at every size of set."""
    agree = []
    for _ in range(60):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(size)], np.uint64))
        b = np.unique(np.concatenate((a[: -(-4 * size // 5)], np.array([r.getrandbits(64) for _ in range(size // 5)], np.uint64))))
        both = len(np.intersect1d(a, b))
        agree.append((M.signature(a) == M.signature(b)).mean() - both / (len(a) + len(b) - both))
    assert abs(np.mean(agree)) < 0.05
    assert (M.signature(a) == M.signature(a)).all() and np.isin(M.signature(a), a).all()


def test_pairs_at_the_limit_share_a_bucket():
    missed = 0
    for _ in range(400):
        n = r.choice([10, 40, 200, 1000])
        both, rest = 8 * n // 10, n - 8 * n // 10
        common, more = (np.array([r.getrandbits(64) for _ in range(k)], np.uint64) for k in (both, rest))
        x, y = (M.signature(np.unique(np.concatenate((common, more[s])))) for s in (slice(0, rest // 2), slice(rest // 2, None)))
        missed += not (M.bands(x) == M.bands(y)).any() or (x.astype(np.uint8) == y.astype(np.uint8)).sum() < M.NEAR
    assert missed == 0


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [((False, 1), 0, 1, True)]
    with pytest.raises(ValueError, match="80"):
        got(spark, [], percent=50)
