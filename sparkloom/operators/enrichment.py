"""Enrichment of chunks from what detectors return: entities, key phrases, spans to redact, JSON of language models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import trim_all


def key_phrases(phrases: Column, most: int = 10, at_least: float = 0.9) -> Column:
    """phrases: array<struct<text, score>>. The best ``most`` by score, of which those that reach the threshold stay."""
    ranked = F.array_sort(F.transform(phrases, lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p["text"].alias("t"))))
    return F.transform(F.filter(F.slice(ranked, 1, most), lambda p: -p["s"] >= at_least), lambda p: p["t"])


def organised_entities(entities: DataFrame, most: int = 20) -> DataFrame:
    """entities(chunk_id, seq, type, text, confidence): at most ``most`` of a type in order, then the repeats of a text (any
    case) merged: the largest confidence, at the place of the first."""
    order = Window.partitionBy("chunk_id", "type").orderBy("seq")
    capped = entities.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    merged = capped.groupBy("chunk_id", "type", F.lower("text").alias("k")).agg(F.min("seq").alias("seq"), F.min_by("text", "seq").alias("text"), F.max("confidence").alias("confidence"))
    by_type = merged.groupBy("chunk_id", "type").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "confidence"))).alias("found"))
    listed = by_type.select("chunk_id", "type", F.transform("found", lambda e: F.struct(e["text"].alias("text"), e["confidence"].alias("confidence"))).alias("found"))
    return listed.groupBy("chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "found")))).alias("entities"))


def chunk_text(by: str = "truth") -> Column:
    """The text of a chunk row: the first of content, content_only, text that is there ('presence'), or isn't blank ('truth')."""
    names = ("content", "content_only", "text")
    return F.coalesce(*[F.col(n) if by == "presence" else F.nullif(F.col(n), F.lit("")) for n in names])


def before_nlp(text: Column, most: int = 5000) -> Column:
    return F.left(text, F.lit(most))


def redact_spans(text: Column, spans: Column) -> Column:
    """spans: array<struct<start, end, type>> (code points, end exclusive): each replaced by its type in brackets, from the
    right, so that the places to the left stay true."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-s["start"]).alias("b"), s["end"].alias("e"), s["type"].alias("t"))))
    replace = lambda t, s: F.concat(F.substr(t, F.lit(1), -s["b"]), F.lit("[REDACTED_"), s["t"], F.lit("]"), F.substr(t, s["e"] + 1))
    return F.aggregate(order, text, replace)


def without_fences(raw: Column) -> Column:
    """A model's JSON without the code fence around it."""
    return trim_all(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


ANSWER = "redacted_text string, key_phrases array<string>, entities map<string, array<string>>"


def model_answer(raw: Column) -> Column:
    """The answer as a struct, from an object, or from a list of objects: entities joined by type, phrases without repeats in
    order, the last redacted text that isn't empty. Unreadable text gives null."""
    clean = without_fences(raw)
    parts = F.when(clean.startswith("["), F.from_json(clean, f"array<struct<{ANSWER}>>")).otherwise(F.array(F.from_json(clean, ANSWER)))
    texts = F.filter(F.transform(parts, lambda p: F.nullif(p["redacted_text"], F.lit(""))), lambda t: t.isNotNull())
    phrases = F.array_distinct(F.flatten(F.filter(F.transform(parts, lambda p: p["key_phrases"]), lambda x: x.isNotNull())))
    entries = F.flatten(F.filter(F.transform(parts, lambda p: F.map_entries(p["entities"])), lambda x: x.isNotNull()))
    kinds = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    joined = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array_distinct(F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])))))
    readable = F.size(F.filter(parts, lambda p: p.isNotNull() & (p["redacted_text"].isNotNull() | p["key_phrases"].isNotNull() | p["entities"].isNotNull()))) > 0
    return F.when(readable, F.struct(F.get(texts, F.size(texts) - 1).alias("redacted_text"), phrases.alias("key_phrases"), joined.alias("entities")))


def enriched(chunks: DataFrame, detect: Callable[[str], dict] | None = None) -> DataFrame:
    """chunks(chunk_id, content) with entities found by ``detect`` (text to {type: [texts]}; by default, capitalised words).
    Blank chunks pass through unenriched."""
    from sparkloom.functions.text import ENTITY  # noqa: PLC0415

    blank = trim_all(F.coalesce("content", F.lit(""))) == ""
    if detect is None:
        found = F.create_map(F.lit("NAME"), F.array_distinct(F.regexp_extract_all("content", F.lit(ENTITY), F.lit(0))))
    else:
        found = F.pandas_udf(lambda texts: pd.Series([detect(t or "") for t in texts]), "map<string, array<string>>")(F.col("content"))
    return chunks.withColumn("skipped", blank).withColumn("entities", F.when(~blank, found))


# Messages.


def episodic_decision(answer: Column) -> Column:
    """struct(store, answer): what the tag says (no tag: no), and the answer without the tag's line."""
    tag = F.upper(F.regexp_extract(answer, r"(?i)EPISODIC:\s*(YES|NO)", 1))
    clean = trim_all(F.regexp_replace(answer, r"(?im)\nEPISODIC:.*$", ""))
    return F.struct((tag == "YES").alias("store"), F.when(tag == "", answer).otherwise(clean).alias("answer"))


def chart_spec(points: Column) -> Column:
    """struct(ok, reason): a chart needs three points."""
    enough = F.coalesce(F.size(points), F.lit(0)) >= 3
    return F.struct(enough.alias("ok"), F.when(~enough, "at least 3 data points are needed").alias("reason"))


def without_tools(messages: DataFrame) -> DataFrame:
    return messages.where("role <> 'tool'")


def tool_results_for_judge(results: DataFrame) -> DataFrame:
    """The first four results of each answer that aren't questions to the user, 600 characters each, in order."""
    order = Window.partitionBy("answer_id").orderBy("seq")
    kept = results.where("name <> 'ask_user_input'").withColumn("n", F.row_number().over(order)).where("n <= 4")
    return kept.select("answer_id", "seq", F.left("content", F.lit(600)).alias("content"))


def longest_word(words: Column) -> Column:
    """The longest; of equals the last."""
    return F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(best) > F.length(w), best).otherwise(w))


def action_counts(messages: DataFrame, most: int) -> DataFrame:
    """messages(run_id, tool_calls array): for each run the messages that call tools, and whether they keep the limit."""
    calls = F.count_if(F.size(F.coalesce("tool_calls", F.array().cast("array<string>"))) > 0)
    return messages.groupBy("run_id").agg(calls.alias("used")).withColumn("allowed", F.col("used") <= most)


def vocabulary(*tables: DataFrame) -> DataFrame:
    """tables(text): the distinct lower-cased words of all, with the number of texts that have each."""
    out = None
    for t in tables:
        words = t.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("word"))
        out = words if out is None else out.unionByName(words)
    return out.groupBy("word").agg(F.count("*").alias("texts"))


def full_text_search(rows: DataFrame, key: str, query: str) -> DataFrame:
    """rows(key, text) that have every word of the query (any case), with how often they have them: a scan, no index."""
    words = sorted({w for w in query.lower().split() if w})
    own = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    count = lambda w: F.size(F.filter(own, lambda x: x == F.lit(w)))
    counts = [count(w) for w in words]
    found = rows.select(key, F.array(*counts).alias("c"))
    return found.where(F.forall("c", lambda n: n > 0)).select(key, F.aggregate("c", F.lit(0), lambda s, n: s + n).alias("hits"))


def with_figures(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """pages(doc_id, page, text), figures(doc_id, page, n, description): each page with its figures' descriptions after it."""
    lines = figures.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "description"))), lambda f: F.format_string("[Figure %d: %s]", f["n"], f["description"])), "\n").alias("figures"))
    return pages.join(lines, ["doc_id", "page"], "left").select("doc_id", "page", F.concat_ws("\n\n", "text", "figures").alias("text"))
