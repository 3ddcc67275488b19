"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds the anchors: at-signs, plus signs, digits, web schemes and identifier cues.
At each anchor deterministic parsers expand to the left and right and validate what they find: an email around its
at-sign, addresses in dotted form, card numbers (Luhn) and phone numbers from their first character, account and token
values after their cue, postal addresses after a house number. A parser of a kind never goes back before the end of the
kind's last match, so each kind's spans are those of a leftmost, non-overlapping search.

Kinds of the base (email, ip, card, phone) follow the stated patterns exactly; the method adds url, secret, iban, account,
street and ssn spans, and emails whose at-sign is spelled out.

Defined results: null texts count as empty; places are code points, ends exclusive; repeated rows are scanned each; a
null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban", "account", "street", "ssn", "spelled_email")
# The stated patterns, tried at an anchor.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Cues and the parsers of what follows them.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = {
    "token": "secret", "api_key": "secret", "apikey": "secret", "api-key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
    "iban": "iban", "account": "account", "acct": "account", "ssn": "account", "passport": "account",
}
URL = re.compile(r"[^\s\"'<>|]+")
VALUES = {
    "secret": re.compile(r"[A-Za-z_ ]{0,12}\s{0,2}[:=]\s{0,2}[\"']?([^\s\"']{6,})"),
    "iban": re.compile(r"[\s:=#.]{0,6}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{1,4}){2,8})\b"),
    "account": re.compile(r"[\s:=#.]{0,4}(?:number|no|nr|id)?[\s:=#.]{1,4}([A-Za-z]{0,2}[0-9](?:[\x20-]?[0-9]){5,16})\b", re.I),
}
STREET = re.compile(r"[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr)\b")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Ways in which an at-sign is spelled out, and the domain after one.
SPELLED_AT = ("[at]", "(at)", "{at}", "[AT]", "(AT)", "&#64;", "%40")
SPELLED_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[A-Za-z0-9-]+)+", re.I)
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for at in SPELLED_AT:
        found.add_word(at, ("spelled_email", len(at)))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by kind and place."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where each kind's last match ended
    run = -1  # end of the digit run that the last digit anchor began
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at < run:
                continue  # inside a run whose start has been tried: an address can't begin here
            run = at + 1
            while run < len(text) and "0" <= text[run] <= "9":
                run += 1
            if at >= done["ip"] and run < len(text) and text[run] == "." and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    found["ip"].append(m.span())
            if at >= done["ssn"] and run - at == 3 and (m := SSN.match(text, at)):
                done["ssn"] = m.end()
                found["ssn"].append(m.span())
            if at >= done["street"] and run < len(text) and text[run] == " " and (m := STREET.match(text, at)):
                done["street"] = m.end()
                found["street"].append(m.span())
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL_SET:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                done["url"] = m.end()
                found["url"].append((at, m.end()))
        elif kind == "spelled_email":
            stop = at - (at > 0 and text[at - 1] == " ")
            start = stop
            while start > done[kind] and text[start - 1] in LOCAL_SET:
                start -= 1
            if start < stop and (m := SPELLED_DOMAIN.match(text, last + 1)):
                done[kind] = m.end()
                found[kind].append((start, m.end()))
        elif at >= done[kind] and (m := VALUES[kind].match(text, last + 1)):
            start, end = m.span(1)
            while kind == "iban" and start < end and not iban_holds(text[start:end]):
                end = max(start, text.rfind(" ", start, end))  # words that follow may look like groups
            if start < end:
                done[kind] = end
                found[kind].append((start, end))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])


def personal_data(documents: DataFrame, masked: bool = True) -> DataFrame:
    """documents(doc_id, text). Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end by
    start, then kind, joined by commas), and with masked the text with every span replaced by its kind in brackets."""
    small_batches(documents.sparkSession)
    rank = {k: i for i, k in enumerate(KINDS)}

    def scan(batches):
        anchors = automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in RESULT.names[1:]]
            for text in batch.column("text").to_pylist():
                spans = sorted(spans_of(text, anchors), key=lambda s: (s[1], rank[s[0]], s[2]))
                base = [s for s in spans if rank[s[0]] < len(BASE_KINDS)]
                row = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), _mask(text, spans) if masked else None]
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[1:], strict=True))], schema=RESULT)

    kinds = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    found = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(scan, f"doc_id long, {kinds}, base_sha256 string, spans string, masked string")
    return found if masked else found.drop("masked")


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
