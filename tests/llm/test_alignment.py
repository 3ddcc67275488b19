import hashlib
import re
from collections import Counter

import pytest

from sparkloom.llm import alignment as A

TEXTS = [
    "The cat sat on the mat.", "two  spaces and\nlines\n  indented\tby tabs ", " leading", "trailing \n", "\n\n", "   ", "don't we'll <|endoftext|> </s> <unk> <0x41>",
    "Zürich Straße żółć 漢字かな 😀 emoji nbsp em", "a▁b is not a space", "x" * 3000, "code();\r\n}\r\n\r\nmore ;\r x", "١٢٣ 1234567890", "", None, "The cat sat on the mat.",
    "tab\there \x1c separators\x0b \x85 next", "a b  c   d    e", "é combining ‍ joined", "line one.\n\nline two.", "ﬁ ligature ½ ②",
]


def plain(texts):
    """Whole texts encoded at once; links by all pairs of ranges."""
    enc = A.Encoders(f"{A.TOKENIZERS}/byte_bpe_50k.json", f"{A.TOKENIZERS}/piece_bpe_32k.model")
    rows, counts = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        a, b = enc.a.encode(" " + t, add_special_tokens=False).ids, enc.b.encode(t)
        x, y = ([parts[i] for i in ids] for parts, ids in ((enc.a_bytes, a), (enc.b_bytes, b)))
        if b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            rows.append(None)
            continue

        def spans(parts):
            out, at = [], 0
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        x, y = spans(x), spans(y)
        links = [(b[j], a[i]) for i, (s, e) in enumerate(x) for j, (u, v) in enumerate(y) if max(s, u) < min(e, v)]
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, x) if low < e <= c) + "|" + ",".join(str(i) for i, (s, e) in zip(b, y) if low < e <= c))
            low = c
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    most = {}
    for (b, _), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == most[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]
    return out, counts, most


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_against_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 3100)
    monkeypatch.setattr(A, "TOGETHER", 2)
    ids = [None if i == 3 else 7 if i in (8, 9) else i for i in range(len(TEXTS))]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids, TEXTS)], "doc_id long, text string, block string, stripe int").repartition(3)
    made = A.Alignment(df)
    want, counts, most = plain(TEXTS)
    assert rows_of(made.documents()) == sorted(((i is None, i or 0), *w) for i, w in zip(ids, want))
    assert sum(w[0] > 0 for w in want) >= 15 and want[8] == (0, 0, 0, 0, 0, 0, "")
    got = {(r.b_id, r.a_id): (r.links, r.best) for r in made.pairs().collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_groups_in_writing(spark):
    [row] = A.Alignment(spark.createDataFrame([(1, "The cat sat.")], "doc_id long, text string"), groups=True).documents().collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_empty(spark):
    assert A.Alignment(spark.createDataFrame([], "doc_id long, text string")).documents().collect() == []
    assert [tuple(r)[1:7] for r in A.Alignment(spark.createDataFrame([(1, None)], "doc_id long, text string")).documents().collect()] == [(0,) * 6]


def test_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select("doc_id", "text")  # the plain version tries all pairs
    rows = df.collect()
    want, *_ = plain([r.text for r in rows])
    assert rows_of(A.Alignment(df).documents()) == sorted(((r.doc_id is None, r.doc_id or 0), *w) for r, w in zip(rows, want))


def test_no_token_crosses_a_piece(monkeypatch):
    enc = A.encoders(f"{A.TOKENIZERS}/byte_bpe_50k.json", f"{A.TOKENIZERS}/piece_bpe_32k.model")
    assert enc.by_space
    for t in filter(None, TEXTS):
        assert " " + t == "".join(" " + p for p in enc.pieces(t)) and not [p for p in enc.pieces(t) if re.search(r"\S ", p)]
    monkeypatch.setattr(A, "REMEMBERED", 4)
    again = A.Encoders(f"{A.TOKENIZERS}/byte_bpe_50k.json", f"{A.TOKENIZERS}/piece_bpe_32k.model")
    for t in ("a b c d e f", "a b c d e f", "e f g"):
        assert [x[:4] for x in again.aligned(enc.pieces(t))] == [x[:4] for x in enc.aligned(enc.pieces(t))]
    again.by_space = False
    assert again.pieces("a b") == ["a b"]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_planes(n):
    import numpy as np

    x = np.arange(n) * 7919
    assert (A.numbers(A.planes(x)) == x).all() and (A.numbers(A.planes(x, "<u8"), "<u8") == x).all()
