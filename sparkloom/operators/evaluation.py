"""Retrieval and answer metrics, a row for each example, then their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import trim_all


def retrieval_metrics(retrieved: Column, relevant: Column, k: int) -> Column:
    """retrieved: ids best first (repeats count each time); relevant: ids. Precision, recall and F1 to four digits, hit rate and
    nDCG over the first k."""
    wanted = F.array_distinct(relevant)
    return ranked_metrics(F.transform(F.slice(retrieved, 1, k), lambda r: F.array_contains(wanted, r)), F.size(wanted), k)


def ranked_metrics(flags: Column, relevant: Column, k: int) -> Column:
    """The same from whether each retrieved row is relevant, best first, and the number of relevant ones: no list of them."""
    hits = F.size(F.filter(flags, lambda f: f))
    precision, recall = hits / F.greatest(F.size(flags), F.lit(1)), hits / F.greatest(relevant, F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    gain = lambda gains: F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    dcg = gain(F.transform(flags, lambda f, i: F.when(f, 1.0 / F.log2(i + 2.0)).otherwise(0.0)))
    best = F.least(relevant, F.lit(k))
    ideal = gain(F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i < best), lambda i: 1.0 / F.log2(i + 2.0)))
    return F.struct(
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.round(F.when(ideal > 0, dcg / ideal).otherwise(0.0), 4).alias("ndcg"),
    )


def clean_text(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""))


def exact_match(answer: Column, reference: Column) -> Column:
    return (clean_text(answer) == clean_text(reference)).cast("double")


def token_f1(rows: DataFrame, key: str, answer: str, reference: str) -> DataFrame:
    """key, token_f1: overlap of the two bags of words. Counted by (key, word), so a word that repeats is one row."""
    words = lambda c: F.explode(F.filter(F.split(clean_text(F.col(c)), r"\s+"), lambda w: w != ""))
    both = rows.select(key, words(answer).alias("w"), F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(rows.select(key, words(reference).alias("w"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    counts = both.groupBy(key, "w").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    sums = counts.groupBy(key).agg(F.sum(F.least("a", "r")).alias("same"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    p, r = F.col("same") / F.greatest("a", F.lit(1)), F.col("same") / F.greatest("r", F.lit(1))
    f1 = F.when(F.col("same") > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0)
    return rows.select(key).join(sums.select(key, f1.alias("token_f1")), key, "left").na.fill(0.0, ["token_f1"])


def rag_triad(a: Column, b: Column, c: Column) -> Column:
    under = a * b + b * c + a * c
    return F.when(under == 0, 0.0).otherwise(3 * a * b * c / under)


def judge_score(raw: Column) -> Column:
    """A number between 0 and 1 from a judge's text; 0 if it can't be read."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.0)


def averages(rows: DataFrame, names: list[str]) -> DataFrame:
    """Means to four digits; rows that failed (null) count as 0."""
    return rows.agg(*[F.round(F.avg(F.coalesce(n, F.lit(0.0))), 4).alias(n) for n in names])


def output_guard(answer: Column, faithfulness: Column, consistency: Column, directive: Column) -> Column:
    """What happens to an answer: passed as a sentinel, blocked by a pattern or a low score, passed with a disclaimer, or passed."""
    return (
        F.when(answer.startswith("__"), "skip").when(directive.isNotNull(), "blocked_pattern").when(faithfulness < 0.85, "blocked_faithfulness").when(consistency < 0.5, "blocked_consistency")
        .when(F.least(faithfulness, consistency) < 0.75, "disclaimer").otherwise("pass")
    )
