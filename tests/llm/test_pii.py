import hashlib
import random
import re

import pytest

from sparkloom.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def texts():
    r = random.Random(6)
    alphabet = ["a", "b.", "@", ".", "-", "1", "23", "4 5", "+", "(", ")", " ", "255", "256.", "x@y.z", "é", "4111111111111111", "+1 (555) 555-0100", "1.2.3.4", "\n", "%"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]


def test_base_spans_equal_the_patterns():
    anchors = P.automaton()
    for t in [*texts(), "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "٣٤@a.b ²1.2.3.4", "0001.2.3.4", "1" * 5000, "+1 23 " * 200, "a" * 3000 + "@" + "b" * 3000 + ".c"]:
        base = sorted((s for s in P.spans_of(t, anchors) if s[0] in P.BASE_KINDS), key=lambda s: (s[1], P.KINDS.index(s[0])))
        assert base == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("see https://example.com/a?b=1 now", "url", "https://example.com/a?b=1"),
        ("IBAN: DE89 3704 0044 0532 0130 00 ok", "iban", "DE89 3704 0044 0532 0130 00"),
        ("account number: 12345678.", "account", "12345678"),
        ("at 12 Main Street today", "street", "12 Main Street"),
        ("his number 123-45-6789 is", "ssn", "123-45-6789"),
        ("write to jo.doe [at] example [dot] com now", "spelled_email", "jo.doe [at] example [dot] com"),
    ],
)
def test_added_spans(text, kind, value):
    assert [text[s:e] for k, s, e in P.spans_of(text, P.automaton()) if k == kind] == [value]


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(1000, None), (1001, ""), (None, "me@x.org +12 345 678 901"), (None, "me@x.org +12 345 678 901"), (1002, "é " * 40_000 + "me@x.org")]
    got = P.personal_data(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, n_email int")).collect()
    want = []
    for d, t in rows:
        base = plain(t or "")
        counts = tuple(sum(s[0] == k for s in base) for k in P.BASE_KINDS)
        want.append((d, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    assert sorted((tuple(g)[:6] for g in got), key=str) == sorted(want, key=str)
    masked = {g.doc_id: g.masked for g in got}
    assert masked[None] == "[EMAIL] [PHONE]" and masked[1002].endswith("é [EMAIL]")
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
