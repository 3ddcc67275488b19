"""Text expressions: patterns, guards, masks and measures. Native columns, but where Unicode data is needed."""

from __future__ import annotations

import unicodedata
from functools import cache
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard patterns, tried on lower-cased text in this order.
INJECTION = (
    r"ignore\s+(previous|all|prior)\s+instructions",
    r"disregard\s+(the|your|all)\s+(above|previous|prior)",
    r"you\s+are\s+now\s+",
    r"\bact\s+as\b",
    r"pretend\s+(you\s+are|to\s+be)",
    r"\bjailbreak\b",
    r"<\|system\|>",
    r"\[system\]",
    r"new\s+instructions?:",
)
TOXIC = (
    r"\b(kill|murder|harm|attack)\b.{0,30}(person|people|patient|user)",
    r"how\s+to\s+(make|build|create).{0,20}(bomb|weapon|poison)",
)
MEDICAL = (
    r"you\s+should\s+take",
    r"stop\s+your\s+medication",
    r"dosage\s+is\s+\d+",
    r"take\s+\d+\s*mg",
    r"inject\s+yourself",
    r"patient\s+should\s+(stop|start|take|increase|decrease)",
    r"administer\s+\d+",
)
WRITE_WORDS = ("insert", "update", "delete", "drop", "truncate", "alter", "create")
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
CARD = r"\b(?:\d[ \-]?){11,12}(\d)[ \-]?(\d)[ \-]?(\d)[ \-]?(\d)[ \-]?\b"
# Extraction patterns, and words that name financial measures.
MONEY = r"\$\d+(?:\.\d+)?(?:[BMK]|(?:\s?(?:billion|million|thousand)))?"
PERCENT = r"\d+(?:\.\d+)?%"
QUARTER = r"Q[1-4]\s*\d{4}"
FISCAL_YEAR = r"(?:FY|Fiscal Year)\s*\d{4}"
YEAR = r"\b(?:19|20)\d{2}\b"
MEASURES = (
    "revenue", "profit", "loss", "earnings", "ebitda", "ebit", "margin", "growth", "decline", "cash flow", "operating income",
    "net income", "gross profit", "roi", "roa", "roe", "eps", "dividend", "yield", "valuation", "market cap", "enterprise value",
    "debt", "equity", "assets", "liabilities", "capex", "opex",
)
PLAIN_MONEY = r"\$\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*([BMK])?"
PLAIN_PERCENT = r"(\d+(?:\.\d+)?)\s*%"
PLAIN_QUARTER = r"Q[1-4]\s*(?:20\d{2}|FY\d{2}|\d{2})?"
PLAIN_YEAR = r"(?:FY|CY)?\s*20\d{2}"
PLAIN_MEASURE = r"(?i)\b(EBITDA|EPS|ROE|ROI|P/E|revenue|profit|margin)\b"
# Parts and beginnings that make a phrase worthless.
JUNK_PARTS = ("**", "##", "![", "](", "*caption", "*ai analysis", "image**", "table**", "chart**", "axes:", "trends:", "key insights:", "source:", "|", "\n", "<", ">")
GENERIC = (
    "see above", "see below", "as follows", "as shown", "the following", "the above", "the below", "click here", "this report", "this analysis",
    "this visual", "this chart", "this table", "this diagram", "this figure", "this image", "exhibit", "figure", "page", "slide",
)
CHART_WORDS = (
    "x-axis", "y-axis", "horizontal axis", "vertical axis", "the x-axis", "the y-axis", "left", "right", "blue line", "green line", "gold line",
    "red line", "bar chart", "line chart", "pie chart",
)
DATES = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}\b"
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
EXHIBIT = r"(?i)(?:Exhibit|Figure|Table)\s+\d+:"
SENTENCE_GAP = r"(?<=[.!?])\s+"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_hit(text: Column, patterns: Iterable[str]) -> Column:
    """The first of the patterns that the lower-cased text has, or null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(p)) for p in patterns])


def input_guard(text: Column) -> Column:
    """struct(clean, reason): injection only; toxic text is judged elsewhere."""
    hit = first_hit(text, INJECTION)
    return F.struct(hit.isNull().alias("clean"), F.coalesce(F.concat(F.lit("Prompt injection detected: '"), hit, F.lit("'")), F.lit("")).alias("reason"))


def is_toxic(text: Column) -> Column:
    return first_hit(text, TOXIC).isNotNull()


def medical_directive(text: Column) -> Column:
    return first_hit(text, MEDICAL)


def write_word(query: Column) -> Column:
    """The first writing word in a query that should only read, or null."""
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in WRITE_WORDS])


def sanitised(text: Column) -> Column:
    for p in INJECTION:
        text = F.regexp_replace(text, f"(?i){p}", "[REDACTED]")
    return text


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")


def mask_cards(text: Column) -> Column:
    return F.regexp_replace(text, CARD, "****-****-****-$1$2$3$4")


def redact_input(text: Column) -> Column:
    return mask_cards(redact_emails(text))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _longest_first(values: Column, most: int) -> Column:
    order = F.transform(F.array_distinct(values), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.slice(F.transform(F.array_sort(order), lambda s: s["v"]), 1, most)


def _largest_first(values: Column, most: int | None = None) -> Column:
    out = F.sort_array(F.array_distinct(values), asc=False)
    return out if most is None else F.slice(out, 1, most)


def patterns_ranked(text: Column) -> Column:
    """Distinct findings in order: amounts longest first (20 at most; ties by text), the others by text downwards."""
    low = F.lower(text)
    names = F.array(*[F.lit(m) for m in MEASURES])
    return F.struct(
        _longest_first(_found(text, f"(?i){MONEY}"), 20).alias("money"),
        _largest_first(_found(text, PERCENT), 20).alias("percents"),
        _largest_first(_found(text, QUARTER)).alias("quarters"),
        _largest_first(_found(text, f"(?i){FISCAL_YEAR}")).alias("fiscal_years"),
        _largest_first(_found(text, YEAR)).alias("years"),
        F.array_sort(F.filter(names, lambda m: F.contains(low, m))).alias("measures"),
    )


def patterns_in_order(text: Column) -> Column:
    """All findings in the order of the text, with repeats; measures are a set of words as written."""
    money = F.transform(_found(text, PLAIN_MONEY), lambda m: F.concat(F.lit("$"), F.regexp_extract(m, PLAIN_MONEY, 1), F.regexp_extract(m, PLAIN_MONEY, 2)))
    return F.struct(
        money.alias("money"),
        F.regexp_extract_all(text, F.lit(PLAIN_PERCENT), F.lit(1)).alias("percents"),
        _found(text, PLAIN_QUARTER).alias("quarters"),
        _found(text, PLAIN_YEAR).alias("years"),
        F.array_sort(F.array_distinct(_found(text, PLAIN_MEASURE))).alias("measures"),
    )


def money_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(patterns_in_order(text)["money"]))


def is_quality_phrase(phrase: Column) -> Column:
    low = trim_all(F.lower(phrase))
    any_of = lambda tests: F.coalesce(F.greatest(*[t.cast("int") for t in tests]), F.lit(0)) == 1
    junk = any_of([F.contains(low, F.lit(p)) for p in JUNK_PARTS])
    generic = any_of([(low == g) | low.startswith(g + " ") for g in GENERIC])
    number = F.regexp_replace(low, "[,.]", "").rlike(r"^\d+$")
    return (F.length(low) >= 3) & ~junk & ~generic & ~low.isin(*CHART_WORDS) & ~number & phrase.rlike(r"\p{L}")


def quality_metrics(content: Column) -> Column:
    """Counts and features of a chunk; sentences are the gaps between them, one at least."""
    words = F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))
    gaps = F.size(F.split(content, SENTENCE_GAP)) - 1
    sentences = F.when(gaps > 0, gaps).otherwise(1)
    return F.struct(
        words.alias("word_count"), sentences.alias("sentence_count"), F.round(words / sentences, 1).alias("avg_sentence_length"), content.rlike(r"\d+").alias("has_numerical_data"),
        content.rlike(DATES).alias("has_dates"), content.rlike(ENTITY).alias("has_named_entities"), content.rlike(EXHIBIT).alias("has_exhibits"),
    )


def image_path(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"\((figures/[^)]+\.png)\)", 1), F.lit(""))


def source_attribution(content: Column) -> Column:
    return F.nullif(trim_all(F.regexp_extract(content, r"Source:\s*(.+?)(?:\n|$)", 1)), F.lit(""))


def breadcrumb_root(path: Column) -> Column:
    """The first part of a path, by the first separator of the list that it has."""
    out = path
    for sep in reversed([" > ", " / ", " | ", " :: "]):
        out = F.when(F.contains(path, F.lit(sep)), F.substring_index(path, sep, 1)).otherwise(out)
    return trim_all(out)


def root_changes(before: Column, now: Column) -> Column:
    """Whether the root differs; never if either path is empty."""
    some = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(now, F.lit("")) != "")
    return some & (breadcrumb_root(before) != breadcrumb_root(now))


def overlapping_pieces(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of ``size`` characters that begin every ``size - overlap``; the last one ends the text."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * stride + 1, F.lit(size)))


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def html_unescape(text: Column) -> Column:
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def wrap_with_boundaries(kind: Column, ident: Column, page: Column, body: Column, attributes: dict[str, Column]) -> Column:
    """A body between boundary marks; attributes that are null are left out, line ends in them become spaces."""
    value = lambda c: html_escape(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "))
    known = {"type": kind, "id": ident, "page": page.cast("string"), **attributes}
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'{k}="'), value(c), F.lit('"'))) for k, c in known.items()]
    return F.concat(F.lit("<!-- BOUNDARY_START "), F.concat_ws(" ", *parts), F.lit(" -->\n"), body, F.lit("\n<!-- BOUNDARY_END "), F.concat_ws(" ", *parts[:2]), F.lit(" -->"))


# Plain stand-ins by general category, for what a Latin-1 channel can't carry.
STAND_INS = {"Pd": "-", "Pi": '"', "Pf": '"', "Zs": " ", "Zl": " ", "Zp": " "}
NAMED = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2022: "*", 0x2026: "..."}


def for_transport(text: str | None) -> str | None:
    """Composed, then characters over 0xFF as their compatible Latin-1 forms, else a stand-in, else a question mark."""
    if text is None:
        return None
    out = []
    for c in unicodedata.normalize("NFC", text):
        if ord(c) <= 0xFF:
            out.append(c)
        elif ord(c) in NAMED:
            out.append(NAMED[ord(c)])
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) <= 0xFF)
            out.append(plain or STAND_INS.get(unicodedata.category(c), "?"))
    return "".join(out)


PROMPT_QUOTES = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-"}


def clean_prompt(text: str | None) -> str | None:
    """Compatible characters, straight quotes, Latin-1 only, single spaces."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text.translate(str.maketrans(PROMPT_QUOTES)))
    return " ".join("".join(c for c in plain if ord(c) <= 0xFF).split())


#: Code points up to here are mapped one by one in the JVM; texts with others go through Python.
TABLED = 0x3400
#: Letters that join with their neighbours when a text is composed.
JOINING = range(0x1100, 0x1200)


@cache
def _table(f) -> tuple[str, str]:
    """The code points whose image under f is one character or none, and these images; those without one come last."""
    images = {chr(c): f(chr(c)) for c in range(0x80, TABLED) if c not in JOINING and unicodedata.category(chr(c))[0] not in "MC"}
    changed = {c: x for c, x in images.items() if x != c}
    some = {c: x for c, x in changed.items() if len(x) == 1}
    none = [c for c, x in changed.items() if not x]
    return "".join([*some, *none]), "".join(some.values())


def _mapped(f, text: Column, mapped: Column, python: Column) -> Column:
    """mapped, or f(text) in Python for the texts that need it; the others aren't sent."""
    sent = F.when(python, text)
    return F.when(python, F.pandas_udf(lambda values: values.map(f, na_action="ignore"), "string")(sent)).otherwise(mapped)


BEYOND = "[^\\x00-\\xff]"


def transport_safe(text: Column) -> Column:
    """for_transport(): texts with marks to compose, or with code points whose image isn't one character, go through Python."""
    mapped = F.translate(text, *_table(for_transport))
    return _mapped(for_transport, text, mapped, mapped.rlike(BEYOND) | text.rlike("\\p{M}"))


def prompt_clean(text: Column) -> Column:
    """clean_prompt(): by character, so only code points whose image isn't one character or none need Python."""
    mapped = F.translate(text, *_table(_prompt_sign))
    return _mapped(clean_prompt, text, F.trim(F.regexp_replace(mapped, "[\\t-\\r\\x1c-\\x20\\x85\\xa0]+", " ")), mapped.rlike(f"{BEYOND}|[\\u00a8\\u00af\\u00b4\\u00b8\\u00bc-\\u00be]"))


def _prompt_sign(sign: str) -> str:
    """clean_prompt() of a character, white space kept."""
    plain = unicodedata.normalize("NFKD", PROMPT_QUOTES.get(sign, sign))
    return "".join(c for c in plain if ord(c) <= 0xFF)
