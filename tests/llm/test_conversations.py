import hashlib
import heapq
import re
import zlib
from itertools import product

import duckdb
import pytest

from sparkloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind int"


def searched(letters):
    """The least (cost, audit) by trying audits in that order."""
    heap = [(0, "", 0, "")]
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if len(out) > 2 * len(letters) + 2 or not re.fullmatch("s?(ua)*u?", out):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + role))
        if i < len(letters):
            letter, more = letters[i].lower(), 3 * letters[i].isupper()
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if letter != "x":
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + letter))
                for role in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, out + role))


def test_audits_against_search():
    for n in range(5):
        for letters in product("suaxoUSO", repeat=n):
            assert C.audit_of("".join(letters)) == searched("".join(letters)), letters


@pytest.mark.parametrize("letters", ["uauauaua", "suuaaUxxa", "aaaaaaaa", "ssssuuuu", "xxxxxxxx", "auauauau", "uaxuaoSUA", "UUUUAAAA"])
def test_longer_audits(letters):
    assert C.audit_of(letters) == searched(letters)


def plain(rows):
    """What the query returns, from its statement."""
    turns, names = {}, []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        if conv not in turns:
            turns[conv] = []
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            turns[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        seen, faults, letters = set(), [], ""
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if faults[-1] in ("blank", "duplicate") else letter.upper() if faults[-1] else letter
        cost, audit = searched(letters)
        out, rest = [], iter(own)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(rest)
            if letter in "IR":
                last = out[-1][0][:1] if out else ""
                role = "assistant" if last == "u" else "user"
            if letter != "D":
                out.append((role, text))
        numbers = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        names.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return names


def given():
    import random

    r = random.Random(12)
    texts = ["Yes.", "no", "Really? ", "", " \t\n", "é!\x0b", None, "a\nb.", "same.", "same.", ".", "x" * 5000 + "!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "agent"]
    rows = [(c, t if r.random() > 0.05 else None, r.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], r.choice(texts)) for c in range(120) for t in range(r.randint(1, 7)) for _ in range(1 + (r.random() < 0.1))]
    rows += [(None, 1, "user", "No conversation."), (None, None, "assistant", "No turn."), (10**12, 5, "user", "Far."), (10**12, 500, "assistant", "Apart.")]
    dropped = next(t for t in range(10**6) if zlib.crc32(f"777:{t}".encode()) % 20 == 0)
    return [*rows, (777, dropped, "user", "All of it goes."), *rows[:9]]


def rows_of(found):
    return sorted(found, key=lambda x: (x[0] is None, x[0] or 0))


COLUMNS = ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]


def test_against_plain(spark):
    rows = given()
    df = spark.createDataFrame([(*x, "clash", 3) for x in rows], SCHEMA).repartition(5)
    got = rows_of(tuple(x[c] for c in COLUMNS) for x in C.audited(df).collect())
    assert got == rows_of(plain(rows))
    assert next(x for x in got if x[0] == 777)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_against_sql(spark):
    rows = given()
    conversations = spark.createDataFrame([(*x, "clash", 3) for x in rows], SCHEMA).toPandas()  # noqa: F841  read by DuckDB
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    conversations["turn"] = conversations["turn"].astype("Int64")
    db = duckdb.connect()
    db.register("conversations", conversations)
    found = db.execute(C.oracle())
    names = [d[0] for d in found.description]
    assert rows_of(tuple(x[names.index(c)] for c in COLUMNS) for x in found.fetchall()) == rows_of(plain(rows))


def test_repaired_turns_follow_the_pattern(spark):
    found, turns = C.repair(spark.createDataFrame([(*x, "clash", 3) for x in given()], SCHEMA))
    by = {}
    for x in sorted(turns.collect(), key=lambda x: x.place):
        by.setdefault(x.conv_id, []).append(x.role[:1])
    assert len(by) > 50 and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())
    assert found.count() == len({x[0] for x in given()})


def test_a_conversation_of_many_turns(spark):
    df = spark.range(20000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    found, turns = C.repair(df)
    assert [(r.cost, set(r.audit), len(r.audit)) for r in found.collect()] == [(0, {"K"}, 20000)] and turns.count() == 20000


def test_empty(spark):
    assert C.audited(spark.createDataFrame([], SCHEMA)).collect() == []
