"""Conversation structure repair over a bidirectional DAG of tight edits.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its turns are edited: Keep costs 0, Rerole to user or
assistant 3, Delete 4, Insert an empty turn 3; turns without text and repeated ones must be deleted, and truncated ones
that stay add 3. The edits are arcs between nodes (turns read, state of the pattern). Forward and backward least costs show
which arcs lie on some cheapest path (forward + cost + backward = total); following the set of nodes that the same letters
reach, and taking the least letter among their tight arcs at each step, gives the cheapest audit that is least in ASCII. An
audit fixes the repaired turns: a new role follows from its place.

The turns are judged without their texts: what repeats is found by (conversation, digest), so that a conversation of very
many turns is shared out, and the rest of a conversation is a byte a turn. Only the last step brings the texts together,
where they stream past their conversation's audit and none is held.

Defined results: null conv_ids are one conversation; null turns come first; a null role or text is one space; of turns with
equal numbers the order is that of their digests; other columns are ignored; an initial is a role's first character, so
other roles can only be rerolled or deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small_batches

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States of the pattern: nothing yet, after the system's turn, after a user's, after an assistant's; where it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after the only turn that rerole or insert can make.
NEXT = [USER, USER, ASSISTANT, USER]
FAR = 1 << 60
SPACES = " \t\n\x0b\f\r"
#: A turn in a letter: the role's initial if the pattern knows it, or "-"; upper case if truncated; "x" if it must go.
MUST_GO = "x"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the turns that are left after damage, which depends on conv_id and turn only: of twenty
    one each is dropped, emptied, loses its end marks, is repeated, or becomes the user's. ``there`` is false for a
    dropped turn, which stays as a mark that the conversation was there."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    changed = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 0, F.lit("")).when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate != 0).alias("there"),
        F.when(fate == 3, 2).otherwise(1).alias("times"),
    )
    return changed.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def digest() -> Column:
    """Tells turns of a conversation apart by role and text."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, initial, fault of turns(conv_id, turn, role, text, there)."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    bare = turns.select("conv_id", "turn", "there", F.when(F.col("there"), digest()).alias("digest"), F.left("role", F.lit(1)).alias("initial"), end.alias("end"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("end") == "", "blank").when(again, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return bare.select("conv_id", "turn", "there", "digest", "initial", fault.alias("fault"))


def costs(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from the start to (turns read, state), and from there to an end."""

    def inserted(row: list[int], step: list[int]) -> list[int]:
        for _ in range(3):  # no cheapest path inserts more turns in a row
            row = [min(c, *(row[p] + INSERT for p in range(4) if step[p] == q)) if any(step[p] == q for p in range(4)) else c for q, c in enumerate(row)]
        return row

    ahead = np.full((len(letters) + 1, 4), FAR, np.int64)
    row = inserted([0, FAR, FAR, FAR], NEXT)
    ahead[0] = row
    for i, letter in enumerate(letters):
        after = [c + DELETE for c in row]
        for cost, p, q in stays(letter):
            after[q] = min(after[q], row[p] + cost)
        row = inserted(after, NEXT)
        ahead[i + 1] = row
    behind = np.full((len(letters) + 1, 4), FAR, np.int64)

    def before(row: list[int]) -> list[int]:
        for _ in range(3):
            row = [min(c, row[NEXT[p]] + INSERT) for p, c in enumerate(row)]
        return row

    row = before([0 if q in ENDS else FAR for q in range(4)])
    behind[-1] = row
    for i in range(len(letters) - 1, -1, -1):
        now = [c + DELETE for c in row]
        for cost, p, q in stays(letters[i]):
            now[p] = min(now[p], row[q] + cost)
        row = before(now)
        behind[i] = row
    return ahead, behind


@lru_cache(maxsize=64)
def stays(letter: str) -> tuple[tuple[int, int, int], ...]:
    """(cost, from, to) of the ways that a turn can stay."""
    if letter == MUST_GO:
        return ()
    more = TRUNCATED * letter.isupper()
    kept = [(KEEP + more, p, q) for (p, initial), q in AFTER.items() if initial == letter.lower()]
    return (*kept, *((REROLE + more, p, NEXT[p]) for p in range(4)))


@lru_cache(maxsize=50_000)
def audit_of(letters: str) -> tuple[int, str]:
    """The least cost, and of the audits with that cost the least in ASCII."""
    ahead, behind = costs(letters)
    total = int(behind[0][START])
    audit, i, front = [], 0, {START}
    while not (i == len(letters) and front & set(ENDS)):
        here, there = ahead[i], behind[min(i + 1, len(letters))]
        more = TRUNCATED * (i < len(letters) and letters[i].isupper())
        for name in "DIKR":
            if name == "I":
                found = {NEXT[p] for p in front if here[p] + INSERT + behind[i][NEXT[p]] == total}
            elif i == len(letters) or name != "D" and letters[i] == MUST_GO:
                continue
            elif name == "D":
                found = {p for p in front if here[p] + DELETE + there[p] == total}
            elif name == "K":
                found = {q for p in front if (q := AFTER.get((p, letters[i].lower()))) is not None and here[p] + KEEP + more + there[q] == total}
            else:
                found = {NEXT[p] for p in front if here[p] + REROLE + more + there[NEXT[p]] == total}
            if found:
                audit.append(name)
                front, i = found, i + (name != "I")
                break
        else:  # a tight node has a tight arc
            raise AssertionError(letters)
    return total, "".join(audit)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
AUDIT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
AUDIT_DDL = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"


class _Open:
    """What is known of a conversation while its turns, in order, go by: a byte a turn."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.faults = conv_id, bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.distinct = self.illegal = 0

    def add(self, turn, initial, fault) -> None:
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if fault:
            self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        known = initial if initial in ("s", "u", "a") else "-"
        self.letters += (MUST_GO if fault in ("blank", "duplicate") else (known.upper() if known != "-" else "=") if fault else known).encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        letters = self.letters.decode().replace("=", "O").replace("-", "o")
        cost, audit = audit_of(letters) if len(letters) <= 64 else audit_of.__wrapped__(letters)
        return self.conv_id, gaps, *self.faults.values(), self.illegal, cost, audit


def audits(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns(conv_id, turn, role, text, there): faults, least cost and audit."""
    small_batches(turns.sparkSession, 10_000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), AUDIT, strict=True)], schema=AUDIT)

        for batch in batches:
            for conv_id, turn, there, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "there", "initial", "fault")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Open(conv_id)
                if there:
                    now.add(turn, initial, fault)
            if done:
                yield rows()
                done = []
        if now is not None:
            done.append(now.row())
            yield rows()

    repeats = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal turns the one that stays comes first
    dealt = judged(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", repeats)
    return dealt.mapInArrow(scan, AUDIT_DDL)


def repaired_turns(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that an audit leaves or makes of a conversation's."""
    place, system = 0, False
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "K":
            system = system or not place and role.startswith("s")
        else:
            role = "user" if (place - system) % 2 == 0 else "assistant"
        yield role, text
        place += 1


def _dealt(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its turns in order."""
    none = F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"), *COUNTS, "audit")
    rows = turns.where("there").select("conv_id", F.lit(1).alias("kind"), "turn", digest().alias("digest"), "role", "text", *[none.cast("long").alias(c) for c in COUNTS], none.cast("string").alias("audit"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").select("role", "text", "conv_id", "kind", *COUNTS, "audit")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(audit row, turns) of each conversation in a dealt partition; the turns are read while they are asked for."""
    names = ["conv_id", *COUNTS, "audit"]

    def all_rows():
        for batch in batches:
            for r in range(0, batch.num_rows, 1000):
                part = batch.slice(r, 1000)
                yield from zip(*(part.column(c).to_pylist() for c in ("kind", "role", "text")), zip(*(part.column(c).to_pylist() for c in names), strict=True), strict=True)

    rows = all_rows()
    ahead: list = [next(rows, None)]
    while ahead[0] is not None:
        head = ahead[0][3]

        def turns():
            while (row := next(rows, None)) is not None and row[0]:
                yield row[1], row[2]
            ahead[0] = row

        own = turns()
        yield head, own
        for _ in own:  # what the audit didn't ask for
            pass


def with_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """found, with the SHA-256 of each conversation's repaired turns, ``role:text`` joined by newlines."""
    schema = pa.schema([*AUDIT, ("repaired_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for head, own in _conversations(batches):
            sha, gap = hashlib.sha256(), ""
            for role, text in repaired_turns(head[-1], own):
                sha.update(f"{gap}{role}:{text}".encode())
                gap = "\n"
            done.append((*head, sha.hexdigest()))
            if len(done) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return _dealt(turns, found).mapInArrow(scan, f"{AUDIT_DDL}, repaired_sha256 string")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the turns of the repaired conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for head, own in _conversations(batches):
            for place, (role, text) in enumerate(repaired_turns(head[-1], own)):
                done.append((head[0], place, role, text))
                if len(done) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return _dealt(turns, found).mapInArrow(scan, "conv_id long, place long, role string, text string")


def repair(conversations: DataFrame, damage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of conversations(conv_id, turn, role, text), damaged first if asked for."""
    turns = damaged(conversations) if damage else conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(True).alias("there"))
    found = Scratch(turns.sparkSession, "conversations").table(audits(turns), "audits")
    return found, repaired(turns, found)


def audited(conversations: DataFrame) -> DataFrame:
    """The audits of the damaged conversations, with digests of what their repair leaves."""
    turns = damaged(conversations)
    found = Scratch(turns.sparkSession, "conversations").table(audits(turns), "audits")
    return with_digests(turns, found)


def oracle() -> str:
    """The same in SQL: the least (cost, audit) of each state, turn by turn, in one string whose order is that of the pair."""

    def add(v: str, cost: str, letter: str) -> str:
        return f"lpad((CAST(substr({v}, 1, 9) AS BIGINT) + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letter}'"

    def kept(v: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(v, 'more', 'K')} END"

    def reroled(v: str) -> str:
        return f"CASE WHEN NOT gone THEN {add(v, '3 + more', 'R')} END"

    to_user = ", ".join(f"{kept(v, 'u')}, {reroled(v)}" for v in ("v0", "vs", "va"))
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda c, b: {bit}), 4294967295)"
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fates AS (SELECT conv_id, turn, role, text, {crc} % 20 AS fate FROM named),
turns AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fates, LATERAL (SELECT unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END))) WHERE fate <> 0),
keyed AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || text) AS digest FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, left(role, 1) AS initial FROM keyed),
repeats AS (SELECT *, i > min(i) OVER (PARTITION BY conv_id, digest) AS again FROM placed),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM repeats),
judged AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM faults),
states AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS vs, '000000003I' AS vu, '000000006II' AS va
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, v0, vs, least(nu, {add('na', '3', 'I')}) AS vu, na AS va FROM (
    SELECT conv_id, i, v0, vs, nu, least(va, {add('nu', '3', 'I')}) AS na FROM (
      SELECT conv_id, i, v0, vs, va, least(vu, {add('v0', '3', 'I')}, {add('vs', '3', 'I')}, {add('va', '3', 'I')}) AS nu FROM (
        SELECT s.conv_id, s.i + 1 AS i, {add('v0', '4', 'D')} AS v0, least({add('vs', '4', 'D')}, {kept('v0', 's')}) AS vs,
          least({add('vu', '4', 'D')}, {to_user}) AS vu, least({add('va', '4', 'D')}, {kept('vu', 'a')}, {reroled('vu')}) AS va
        FROM states s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1)))),
best AS (SELECT conv_id, max_by(least(v0, va), i) AS v FROM states GROUP BY conv_id),
audits AS (SELECT conv_id, CAST(substr(v, 1, 9) AS BIGINT) AS cost, substr(v, 10) AS audit FROM best),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
edits AS (SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
kept AS (SELECT e.conv_id, p, letter, CASE letter WHEN 'I' THEN '' ELSE role END AS role, CASE letter WHEN 'I' THEN '' ELSE text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS place
    FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i WHERE letter <> 'D'),
headed AS (SELECT *, first_value(letter = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id ORDER BY p) AS system FROM kept),
written AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE
      CASE WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY p)) AS sha
    FROM headed GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM audits a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM a.conv_id"""
