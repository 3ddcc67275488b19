"""A hidden Markov language model, and exact likelihoods under it.

Tokens are the words of a text and one end. Every training token is counted. The states emit symbols: the commonest tokens
have one each, all others share one, and are then told apart by their smoothed counts, so the model is a distribution
over all tokens. Baum-Welch trains the states: each task adds up its expected counts, the sums meet by (state, symbol) in
a shuffle, and only the table of parameters comes to the driver. A text's likelihood is the scaled forward recursion;
it runs over pieces of a text side by side, as products of transition matrices, which changes nothing but the order of
work, so a text of any length takes as many steps as a piece.

Counts of the commonest tokens (at most ``common``, of at most ``LONGEST`` bytes each) are broadcast; the rest are joined.

Defined results: null texts count as empty, which is one token, the end; with no training documents every token has count 0
and the states emit every symbol alike; rows with a null doc_id are training rows; repeated rows count and are scored each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, small_batches, text_or_empty

#: The end's name among tokens; no word has white space.
END, LONGEST = b"\n", 64
PIECE = 32
#: Tokens of the texts that are worked on side by side.
GROUP = 400_000
#: Entries that a task counts before it sends them.
HELD = 200_000


def held_out(key: str = "doc_id", folds: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % folds == rest, F.lit(False))


def token_counts(documents: DataFrame) -> DataFrame:
    """documents(text). Returns token (binary) and n."""
    small_batches(documents.sparkSession, 500)
    names = ["token", "n"]

    def scan(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=names)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(text.lower().split())
                held[END] += 1
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counted = documents.select(text_or_empty().cast("binary").alias("text")).mapInArrow(scan, "token binary, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def common_tokens(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the commonest tokens of at most LONGEST bytes, commonest first; from a histogram of counts by
    their twelve leading bits, not from a sort."""
    short = counts.where(F.octet_length("token") <= LONGEST)
    level = F.expr("greatest(0, cast(floor(log2(n)) as int) - 11)")
    levels = short.withColumn("drop", level).groupBy(F.expr("shiftleft(shiftright(n, drop), drop)").alias("level")).count().collect()
    total, least = 0, None
    for r in sorted(levels, reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(((bytes(r["token"]), r["n"]) for r in short.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


class Lexicon:
    """The common tokens and their counts; the first ``symbols - 1`` have symbols of their own, 0, 1, ..."""

    def __init__(self, common: list[tuple[bytes, int]], symbols: int, total: int, kinds: int):
        self.index = {t: i for i, (t, _) in enumerate(common)}
        self.logs = np.log10(np.array([n for _, n in common], np.float64) + 1)
        self.own = min(symbols - 1, len(common))
        self.symbols = self.own + 1
        own = sum(n for _, n in common[: self.own])
        self.total, self.kinds = total, kinds
        self.counts = np.array([*(n for _, n in common[: self.own]), total - own], np.float64)
        self.base_log = math.log10(total + kinds + 1)
        self.rest_log = math.log10(total - own + kinds - self.own + 1)  # of what the last symbol stands for


ENCODED = "row long, doc_id long, training boolean, symbols binary, n_tokens long, n_known long, known_log double, rest_log double, n_rest long, token binary, times long"
ENCODED_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64()), ("rest_log", pa.float64()), ("n_rest", pa.int64()), ("token", pa.binary()), ("times", pa.int64())])


def encode(documents: DataFrame, lexicon) -> DataFrame:
    """documents(row, doc_id, training, text): a row for each text with its symbols and the sums over common tokens, and a
    row for each other token of the text."""

    def scan(batches):
        words = lexicon.value
        get, own, common = words.index.get, words.own, len(words.index)
        for batch in batches:
            columns: list[list] = [[] for _ in ENCODED_SCHEMA]
            for row, doc_id, training, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "training", "text")), strict=True):
                tokens = text.lower().split()
                tokens.append(END)
                ids = np.fromiter((get(t, common) for t in tokens), np.int32, len(tokens))
                known = ids < common
                seen = ids[known]
                shared = seen[seen >= own]
                rare = np.flatnonzero(~known)
                logs = words.logs[seen]
                whole = (row, doc_id, training, np.minimum(ids, own).astype(np.int16).tobytes(), len(tokens), len(seen), float(logs.sum()), float(words.logs[shared].sum()), int((ids >= own).sum()), None, None)
                for c, x in zip(columns, whole, strict=True):
                    c.append(x)
                for token, times in Counter(tokens[i] for i in rare.tolist()).items():
                    for c, x in zip(columns, (row, None, None, None, None, None, None, None, None, token, times), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENCODED_SCHEMA, strict=True)], schema=ENCODED_SCHEMA)

    return documents.mapInArrow(scan, ENCODED)


class Pieces:
    """The symbols of some texts in pieces of PIECE, the last of each text padded."""

    def __init__(self, texts: list[np.ndarray], pad: int):
        size = np.array([len(t) for t in texts], np.int64)
        self.per = -(-size // PIECE)
        self.first = np.cumsum(self.per) - self.per
        n = int(self.per.sum())
        flat = np.full(n * PIECE, pad, np.int32)
        begin = np.repeat(self.first * PIECE, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[begin] = np.concatenate(texts) if texts else []
        self.symbols = flat.reshape(n, PIECE)
        self.pad = pad


class Model:
    """Parameters of the states. Arrays over pieces have the pieces last, so that each step is a few long vector passes.

    Padding has emissions of one. As the rows of ``move`` sum to one, steps over it change no likelihood."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def padded_emit(self) -> np.ndarray:
        return np.hstack((self.emit, np.ones((len(self.start), 1))))

    def products(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the product of its steps, (state after, state before, piece), scaled, and the log of the scale."""
        emit, k, n = self.padded_emit(), len(self.start), len(pieces.symbols)
        out = np.zeros((k, k, n))
        out[np.arange(k), np.arange(k)] = 1
        logs = np.zeros(n)
        for j in range(PIECE):
            out = (self.move.T @ out.reshape(k, k * n)).reshape(k, k, n)
            out *= np.take(emit, pieces.symbols[:, j], axis=1)[:, None, :]
            if j % 8 == 7:
                top = out.max((0, 1))
                out /= top
                logs += np.log(top)
        return out, logs

    def boundaries(self, pieces: Pieces, products: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states before each piece, given what came before, and the log likelihood of each text."""
        n_texts, k = len(pieces.per), len(self.start)
        entry = np.zeros((k, len(logs)))
        now = np.repeat(self.start[:, None], n_texts, 1)
        total = np.zeros(n_texts)
        for step in range(int(pieces.per.max()) if n_texts else 0):
            live = np.flatnonzero(pieces.per > step)
            at = pieces.first[live] + step
            entry[:, at] = now[:, live]
            after = (products[:, :, at] * now[None, :, live]).sum(1)
            scale = after.sum(0)
            now[:, live] = after / scale
            total[live] += np.log(scale) + logs[at]
        return entry, total

    def log_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        pieces = Pieces(texts, self.emit.shape[1])
        return self.boundaries(pieces, *self.products(pieces))[1]

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of the texts, and their log likelihood. The distribution ``start`` is that
        before the first move."""
        k, m = self.emit.shape
        pieces = Pieces(texts, m)
        products, logs = self.products(pieces)
        entry, total = self.boundaries(pieces, products, logs)
        n = len(logs)
        behind = np.ones((k, n))
        back = np.ones((k, len(pieces.per)))
        for step in range(int(pieces.per.max()) - 1, -1, -1):
            live = np.flatnonzero(pieces.per > step)
            at = pieces.first[live] + step
            behind[:, at] = back[:, live]
            before = (products[:, :, at] * back[:, None, live]).sum(0)
            back[:, live] = before / before.sum(0)
        emit, move = self.padded_emit(), self.move
        ahead = np.empty((PIECE, k, n))
        now = entry
        for j in range(PIECE):
            now = move.T @ now
            now *= np.take(emit, pieces.symbols[:, j], axis=1)
            now /= now.sum(0)
            ahead[j] = now
        moves, emits = np.zeros((k, k)), np.zeros((k, m + 1))
        for j in range(PIECE - 1, -1, -1):
            s = pieces.symbols[:, j]
            weight = ahead[j] * behind
            weight /= weight.sum(0)
            for i in range(k):
                emits[i] += np.bincount(s, weight[i], m + 1)
            past = ahead[j - 1] if j else entry
            onward = np.take(emit, s, axis=1)
            onward *= behind
            behind = move @ onward
            pair = (past * behind).sum(0)
            moves += (past * ((s != m) / pair)) @ onward.T
            behind = behind / behind.sum(0)
        start = entry[:, pieces.first] * behind[:, pieces.first]
        return (start / start.sum(0)).sum(1), moves * move, emits[:, :m], float(total.sum())


def begin(lexicon: Lexicon, states: int, seed: int) -> Model:
    """Unigram emissions with noise in each state, and states that stay."""
    r = np.random.default_rng(seed)
    share = (lexicon.counts + 0.5) / (lexicon.counts + 0.5).sum()
    emit = share * np.exp(r.normal(0, 1.0, (states, lexicon.symbols)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int16).astype(np.int32) for b in batch.column("symbols").to_pylist()]


def _groups(texts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The texts in order, in groups of bounded length, which bounds the arrays over their pieces."""
    out, size = [], GROUP
    for t in texts:
        if size + len(t) > GROUP:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def baum_welch(texts: DataFrame, model: Model, rounds: int) -> tuple[Model, list[float]]:
    """texts(symbols). Re-estimates the model ``rounds`` times from all of them; the log likelihoods before each round."""
    spark = texts.sparkSession
    k, m = model.emit.shape
    seen = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def scan(batches, shared=shared):
            now = shared.value
            starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, m)), 0.0
            for batch in batches:
                for texts in _groups(_texts(batch)):
                    a, b, c, d = now.expected(texts)
                    starts, moves, emits, total = starts + a, moves + b, emits + c, total + d
            flat = np.concatenate((starts, moves.ravel(), emits.ravel(), [total]))
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "value"])

        sums = texts.select("symbols").mapInArrow(scan, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        flat = np.zeros(k + k * k + k * m + 1)
        for r in sums.collect():  # the table of parameters: its size is fixed
            flat[r["cell"]] = r["value"]
        starts, moves, emits = flat[:k] + 1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k : -1].reshape(k, m) + 0.01
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
        seen.append(float(flat[-1]))
    return model, seen


def score(documents: DataFrame, training: Column, states: int = 4, symbols: int = 4096, rounds: int = 4, common: int = 100_000, seed: int = 1) -> DataFrame:
    """documents(doc_id, text); training: which rows the model learns from. Returns doc_id, n_tokens, n_known, train_tokens,
    base_score and score, both log10 probabilities of the whole text."""
    spark = documents.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark, "hmm")
    counts = scratch.table(token_counts(documents.where(training)), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lexicon = Lexicon(common_tokens(counts, common), symbols, total, kinds)
    shared = spark.sparkContext.broadcast(lexicon)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), text_or_empty().cast("binary").alias("text"))
    encoded = scratch.table(encode(rows, shared), "encoded")
    texts = encoded.where("symbols is not null")
    model, _ = baum_welch(texts.where("training"), begin(lexicon, states, seed), rounds)
    fitted = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "known_log", "rest_log", "n_rest", "forward"]

    def forward(batches):
        for batch in batches:
            found = np.concatenate([np.zeros(0), *map(fitted.value.log_likelihood, _groups(_texts(batch)))]) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(found)], names=names)

    scored = texts.select(*names[:-1], "symbols").mapInArrow(forward, "row long, doc_id long, n_tokens long, n_known long, known_log double, rest_log double, n_rest long, forward double")
    rare = encoded.where("token is not null").select("row", "token", "times").join(counts, "token", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)
    rest = rare.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_log") + zero("log") - F.col("n_tokens") * lexicon.base_log).alias("base_score"),
        (F.col("forward") + F.col("rest_log") + zero("log") - F.col("n_rest") * lexicon.rest_log).alias("score"),
    )
