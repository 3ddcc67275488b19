"""Mixing documents to target token weights by soft membership; DataFrame operations only.

A classifier learned from the labelled table gives each document a posterior over the domains good, plain and toxic. Its
features are the distinct lower-cased words of the whole text, the signs that come doubled in it or stand alone, and
whether few kinds of words fill it. Features that a good share of plain or of toxic documents has, and good ones
rarely, are evidence; the sums of their log odds are binned, and a bin's posterior is the share of each domain among the
labelled documents in it.

Each document then gets a rate, the expected number of copies. Rates are nonnegative, start at 1, and take projected
gradient steps that lower the squared miss of the expected tokens of each domain (sums of rate x tokens x posterior)
from the targets, measured in the norm in which a full step is safe. A rate is a function of the posterior and the steps so
far, so a step is one aggregation, of the tokens of all documents summed by posterior, and nothing is kept for each
document between steps. Targets are shares of the mixture, or what there is if that is less, so a share of toxic tokens
stays: up to 2 % of the mixture by default.

The evidence is learned from at most ``max_labelled`` labelled documents (those with the smallest hash of their id), the
posteriors from all labelled ones, totals and rates from all documents.

Defined results: null texts count as empty and have no tokens; without any label all domains are equally likely; rows with
a null label or doc_id teach nothing; of several labels of one doc_id the worst counts; repeated rows get rates of their
own; an empty table gives no rows. Targets that no rates meet are met as nearly as they can be.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, text_or_empty

DOMAINS = ("good", "plain", "toxic")
BINS, BIN_WIDTH = 6, 2.0
#: Evidence: a feature of at least this share of a domain's documents that is this much likelier (log) than in good ones.
LEAST_SHARE, STRONG = 0.02, 4.5
#: What ends a word, and signs that are features where they come doubled.
BETWEEN, SIGNS = r"[\x20\x09-\x0D.,;:?]+", "%&*#$!|~^=<>_@+/-"
FEW_KINDS = "\x01few kinds of words"


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain (its number): toxic if toxic, else plain if of low quality."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("domain")).where("doc_id is not null and domain is not null")
    return known.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def words_of(text: Column) -> Column:
    """Lower-cased words; they are counted as the text's tokens. One pass of a pattern, no function for each word."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def marks_of(text: Column, words: Column) -> Column:
    """Features that are no words: doubled signs, and few kinds of words (under a quarter, of twenty or more)."""
    few = (F.size(F.array_distinct(words)) * 4 < F.size(words)) & (F.size(words) >= 20)
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c + c)), F.lit(c + c)) for c in SIGNS], F.when(few, F.lit(FEW_KINDS))))


@dataclass(frozen=True)
class Evidence:
    """For plain and toxic, the features that speak for it and their weights."""

    weights: tuple[dict[str, float], dict[str, float]]

    def columns(self, documents: DataFrame) -> DataFrame:
        """documents with __tokens and the two sums of evidence."""
        names = sorted({n for w in self.weights for n in w})
        known = documents.withColumn("__words", words_of(text_or_empty()))
        hits = F.array_intersect("__words", _constant(names, "array<string>"))
        known = known.withColumns({"__tokens": F.size("__words").cast("long"), "__hits": F.concat(hits, F.array_intersect(marks_of(text_or_empty(), F.col("__words")), _constant(names, "array<string>")))})
        sums = [_sum_of("__hits", names, [w.get(n, 0.0) for n in names]) for w in self.weights]
        return known.withColumns({"__plain": sums[0], "__toxic": sums[1]}).drop("__words", "__hits")


def _constant(values: list, kind: str) -> Column:
    """A list as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _sum_of(hits: str, names: list[str], weights: list[float]) -> Column:
    listed, values = _constant(names, "array<string>"), _constant(weights, "array<double>")
    return F.aggregate(F.array_distinct(hits), F.lit(0.0), lambda total, f: total + F.element_at(values, F.array_position(listed, f).cast("int")))


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = 8000) -> Evidence:
    sample = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    taught = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    words = words_of(F.col("text"))
    known = taught.select("domain", F.array_distinct(F.concat(words, marks_of(F.col("text"), words))).alias("features"))
    total = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    sizes = [total.get(k, 0) for k in range(len(DOMAINS))]
    each = [F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(len(DOMAINS))]
    # explode_outer: for explode, the optimiser would infer a filter on the features and push it below the join
    counts = known.select("domain", F.explode_outer("features").alias("feature")).where("feature is not null").groupBy("feature").agg(*each)
    base = (F.col("n0") + 0.5) / (sizes[0] + 1)
    share = {k: F.col(f"n{k}") / max(1, sizes[k]) for k in (1, 2)}
    speaks = {k: (share[k] >= LEAST_SHARE) & (F.col(f"n{k}") >= 5) & (share[k] > base * math.exp(STRONG)) for k in (1, 2)}
    # a document has few features, so few features are in a fixed share of the documents
    strong = counts.where(speaks[1] | speaks[2]).select("feature", *[F.when(speaks[k], F.log(share[k] / base)).alias(f"w{k}") for k in (1, 2)]).collect()
    weights = [{r["feature"]: round(r[f"w{k}"], 4) for r in strong if r[f"w{k}"] is not None} for k in (1, 2)]
    return Evidence(tuple(weights))


def bin_of(plain: Column, toxic: Column) -> Column:
    level = lambda c: F.least(F.lit(BINS - 1), F.ceil(c / BIN_WIDTH)).cast("int")
    return level(plain) * BINS + level(toxic)


def calibrate(scored: DataFrame, labels: DataFrame) -> list[list[float]]:
    """The posterior of each bin, from all labelled documents; bins with few lean on the labelled shares."""
    rows = scored.select("doc_id", "bin").distinct().join(domain_of(labels), "doc_id").groupBy("bin", "domain").count().collect()
    counts = [[0.0] * len(DOMAINS) for _ in range(BINS * BINS)]
    for r in rows:
        counts[r["bin"]][r["domain"]] = float(r["count"])
    all_of = [sum(c[k] for c in counts) for k in range(len(DOMAINS))]
    total = sum(all_of)
    prior = [(x + 1e-9) / (total + len(DOMAINS) * 1e-9) for x in all_of]
    return [[(c[k] + prior[k]) / (sum(c) + 1) for k in range(len(DOMAINS))] for c in counts]


def posterior_columns(bins: Column, table: list[list[float]]) -> list[Column]:
    return [F.element_at(F.from_json(F.lit(json.dumps([t[k] for t in table])), "array<double>"), bins + 1) for k in range(len(DOMAINS))]


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss-Jordan elimination with pivoting; a little is added to the diagonal for domains without tokens."""
    n = len(right)
    ridge = 1e-9 * (sum(matrix[i][i] for i in range(n)) or 1.0)
    a = [[*row, right[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        a[i][i] += ridge
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def rate_column(posterior: list[Column], steps: list[list[float]]) -> Column:
    """The rate after the steps: moved along the posterior by each, and never under zero."""
    if not steps:
        return F.lit(1.0)
    listed = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    move = lambda step: sum((p * F.element_at(step, i + 1) for i, p in enumerate(posterior)), F.lit(0.0))
    return F.aggregate(listed, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate + move(step)))


def rates_of(table: list[list[float]], steps: list[list[float]]) -> list[float]:
    """The rate of each row of posteriors; as rate_column, for the few bins that there are."""
    out = []
    for posterior in table:
        rate = 1.0
        for step in steps:
            rate = max(0.0, rate + sum(p * x for p, x in zip(posterior, step, strict=True)))
        out.append(rate)
    return out


def fit_rates(scored: DataFrame, shares: dict[str, float], lead_epochs: float, most_steps: int = 25) -> list[list[float]]:
    """Projected steps towards the targets. scored: tokens and p_<domain>. The first domain is read ``lead_epochs`` times;
    the others up to their share beside it, and once at most.

    With M the sum of tokens x posterior x posterior', M^-1 (targets - now) is a gradient step of length one on the squared
    miss in the norm of M^-1, whose gradient changes by no more than the rates do: it never raises the miss. First a longer
    step is tried, with M over the documents whose rates aren't at zero; if it raises the miss, it is taken back."""
    k = len(DOMAINS)
    posterior = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measured(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        rated = scored.withColumn("rate", rate_column(posterior, steps))
        free = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("rate") * F.col("tokens") * p).alias(f"t{i}") for i, p in enumerate(posterior)]
        r = rated.agg(*sums, *[F.sum(free * posterior[i] * posterior[j]).alias(f"m{i}{j}") for i, j in pairs]).first()
        return [float(r[f"t{i}"] or 0) for i in range(k)], [[float(r[f"m{min(i, j)}{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]

    now, normal = measured([])
    budget = lead_epochs * now[0] / shares[DOMAINS[0]]
    targets = [lead_epochs * now[0], *(min(x, shares[d] * budget) for x, d in zip(now[1:], DOMAINS[1:], strict=True))]
    missing = lambda x: [t - y for t, y in zip(targets, x, strict=True)]
    size_of = lambda miss: sum(a * b for a, b in zip(miss, solve(normal, miss), strict=True))
    steps: list[list[float]] = []
    miss, size, free = missing(now), size_of(missing(now)), normal
    for _ in range(most_steps):
        if max(map(abs, miss)) <= 1e-6 * max(1.0, sum(targets)):
            break
        for matrix in (free, normal):
            step = solve(matrix, miss)
            then, then_free = measured([*steps, step])
            if size_of(missing(then)) < size:
                break
        else:
            break  # no step helps: the targets are met as nearly as they can be
        gained = size - size_of(missing(then))
        steps.append(step)
        miss, free = missing(then), then_free
        if gained <= 1e-9 * size:
            break
        size -= gained
    return steps


@dataclass(frozen=True)
class Mix:
    evidence: Evidence
    table: list[list[float]]
    steps: list[list[float]]
    scored: DataFrame


SHARES = {"good": 0.88, "plain": 0.10, "toxic": 0.02}


def fit(documents: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, lead_epochs: float = 1.1, max_labelled: int = 8000, whole: bool = False) -> Mix:
    """The evidence of each document is made once and written, with the whole row (row) where that is asked for."""
    scratch = Scratch(documents.sparkSession, "mixing")
    evidence = learn(documents, labels, max_labelled)
    rows = [F.struct(*[documents[c] for c in documents.columns]).alias("row")] if whole else []
    known = evidence.columns(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *rows))
    mark = F.xxhash64("doc_id", text_or_empty())
    kept = ["row"] if whole else []
    scored = scratch.table(known.select("doc_id", F.col("__tokens").alias("tokens"), bin_of(F.col("__plain"), F.col("__toxic")).alias("bin"), mark.alias("mark"), *kept), "scored")
    table = calibrate(scored, labels)
    posterior = [c.alias(f"p_{d}") for c, d in zip(posterior_columns(F.col("bin"), table), DOMAINS, strict=True)]
    # documents of a bin share their posterior, so its rate too: their tokens are summed once, and steps cost next to nothing
    binned = scratch.table(scored.groupBy("bin").agg(F.sum("tokens").alias("tokens")), "binned").select("tokens", *posterior)
    steps = fit_rates(binned, SHARES if shares is None else shares, lead_epochs)
    return Mix(evidence, table, steps, scored.select("doc_id", "tokens", "mark", "bin", *kept, *posterior))


def copies_of(rate: Column, mark: Column) -> Column:
    """The rate rounded up with the probability of its fraction, by a hash: the same each time, and unbiased."""
    return (F.floor(rate) + F.when(F.pmod(mark, F.lit(1_000_003)) < (rate - F.floor(rate)) * 1_000_003, 1).otherwise(0)).cast("int")


def rates(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality, toxic). Returns doc_id, tokens, p_good, p_plain, p_toxic, rate and
    copies for each document."""
    mix = fit(documents, labels, **options)
    rate = F.element_at(_constant(rates_of(mix.table, mix.steps), "array<double>"), F.col("bin") + 1)
    return mix.scored.withColumn("rate", rate).withColumn("copies", copies_of(F.col("rate"), F.col("mark"))).drop("mark", "bin")


def mixed(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, all columns, each as often as its copies."""
    mix = fit(documents, labels, whole=True, **options)
    rate = F.element_at(_constant(rates_of(mix.table, mix.steps), "array<double>"), F.col("bin") + 1)
    copies = mix.scored.select("row", copies_of(rate, F.col("mark")).alias("copies")).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
