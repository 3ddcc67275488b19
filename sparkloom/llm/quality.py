"""Quality scores by nearest-neighbour voting in a latent semantic space.

Features of a text: hashed counts of its words, hashed counts of character-class trigrams (letters, capitals, digits and
spaces each as a class, signs as themselves) and a few shares (repeated words, capitals, signs). A truncated singular value
decomposition of the labelled texts' weighted features gives the latent space; the labelled vectors in it are broadcast
(at most ``max_labelled`` x ``latent`` numbers, whatever the input). Each document is compared with all of them, exactly,
as one matrix product a block, and its ``neighbours`` nearest ones vote with weights that grow with similarity.

Only the classifier is fitted on a bounded sample of labelled rows (the ``max_labelled`` with the smallest hash of their
doc_id); every document is scored over its whole text.

Defined results: null texts count as empty; a text without features, or a table without usable labels, gets the labelled
share of ones (0.5 without any); rows with a null label or doc_id teach nothing; several labels of one doc_id count as
their mean, and of several texts of one the text with the least hash teaches; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BASE, BYTE_WORDS, gram_hash, mix64, run_starts, small_batches, text_or_empty, utf8_parts
from sparkloom.llm.suffix_dedup import _powers

U = np.uint64
WORDS, SHAPES, SHARES = 768, 768, 8
SIZE = WORDS + SHAPES + SHARES
CHUNK = 1 << 18
#: Classes of bytes: small letters and all bytes over 127 are 97, capitals 65, digits 48; other signs stand for themselves.
CLASS = np.array([97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word (lower-cased A-Z); words end at white space and at the ends of texts. A word that goes on
    past a chunk is carried over, so its hash depends on its bytes only."""
    hashes, owners = [], []
    up, down = _powers(CHUNK + 1)
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begun = None  # hash and length of a word that the last chunk left open
    for a in range(0, len(raw), CHUNK):
        b = min(a + CHUNK, len(raw))
        part = raw[a:b]
        solid = ~SPACE[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[a + 1 : b]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        ends = np.flatnonzero(np.append(~solid[1:] | edge[a + 1 : b], True) & solid) + 1
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(BYTE_WORDS[LOWER[part]] * up[: len(part)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
        own = np.searchsorted(off, starts + a, "right") - 1
        length = int(ends[-1] - starts[-1])
        if begun:
            if len(starts) == 1:
                length += begun[1]
            found[0] = (begun[0] + int(found[0]) * pow(BASE, begun[1], 1 << 64)) & ((1 << 64) - 1)
            begun = None
        if b < len(raw) and solid[-1] and not edge[b] and not SPACE[raw[b]]:
            begun = int(found[-1]), length
            found, own = found[:-1], own[:-1]
        hashes.append(mix64(found))
        owners.append(own)
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of SIZE numbers for each text: damped counts, each family at unit length, then shares."""
    n = len(off) - 1
    out = np.zeros((n, SIZE), np.float32)
    length = np.diff(off)
    words, of = word_hashes(raw, off)
    out[:, :WORDS] = np.bincount(of * WORDS + (words >> U(40)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    shape = CLASS[raw]
    counts = np.zeros(n * SHAPES, np.int64)
    for a in range(0, max(0, len(raw) - 2), CHUNK):
        part = shape[a : a + CHUNK + 2].astype(U)
        at = (gram_hash(part + U(1), 3) * U(0x9E3779B97F4A7C15) >> U(40)).astype(np.int64) % SHAPES
        own = np.repeat(np.arange(n), np.clip(np.minimum(off[1:], a + len(at)) - np.maximum(off[:-1], a), 0, None))
        inside = np.arange(a, a + len(at)) < off[own + 1] - 2
        counts += np.bincount((own * SHAPES + at)[inside], minlength=n * SHAPES)
    out[:, WORDS : WORDS + SHAPES] = counts.reshape(n, SHAPES)
    out = np.log1p(out)
    total = np.maximum(np.bincount(of, minlength=n), 1)
    order = np.lexsort((words, of))
    kinds = np.bincount(of[order][run_starts(of[order], words[order])], minlength=n) if len(of) else np.zeros(n)
    same = np.zeros(len(of), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    owner = np.repeat(np.arange(n), length)
    share = lambda mask: np.bincount(owner[mask], minlength=n) / np.maximum(length, 1)
    sign = (shape != 97) & (shape != 65) & (shape != 48) & ~SPACE[shape]
    shares = [kinds / total, np.bincount(of[same], minlength=n) / total, share(shape == 65), share(sign), share(shape == 48), np.minimum(1, length / total / 20), np.log1p(length) / 12, share(raw == 10) * 10]
    out[:, WORDS + SHAPES :] = np.stack(shares, 1) * (length > 0)[:, None]
    return out


class Model:
    """Weights, latent axes and labelled vectors; fitted on one matrix of features and its labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, latent: int = 48, neighbours: int = 15, sharp: float = 12.0):
        self.neighbours, self.sharp = neighbours, sharp
        self.prior = float(labels.mean()) if len(labels) else 0.5
        counted = WORDS + SHAPES
        self.weight = np.ones(SIZE, np.float32)
        self.weight[:counted] = np.log((1 + len(rows)) / (1 + (rows[:, :counted] > 0).sum(0))) + 0.3
        self.centre = rows[:, counted:].mean(0) if len(rows) else np.zeros(SHARES, np.float32)
        self.scale = 1 / (rows[:, counted:].std(0) + 1e-3) if len(rows) else np.ones(SHARES, np.float32)
        x = self.weighted(rows)
        r = np.random.default_rng(5)
        k = min(latent, SIZE, max(1, len(rows)))
        basis = r.standard_normal((SIZE, k + 16)).astype(np.float32)
        for _ in range(5):
            basis, _ = np.linalg.qr(x.T @ (x @ basis)) if len(rows) else (basis, None)
        if len(rows):
            _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
            basis = basis @ axes.T
        self.axes = np.ascontiguousarray(basis[:, :k], np.float32)
        self.vectors, self.labels = self.project(rows), labels.astype(np.float32)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        counted = WORDS + SHAPES
        x = rows * self.weight
        for a, b, part in ((0, WORDS, 0.5), (WORDS, counted, 1.0)):
            x[:, a:b] *= part / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
        some = (rows != 0).any(1, keepdims=True)
        x[:, counted:] = np.clip((rows[:, counted:] - self.centre) * self.scale, -4, 4) * 0.35 * some
        return x.astype(np.float32)

    def project(self, rows: np.ndarray) -> np.ndarray:
        v = self.weighted(rows) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.project(rows) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        close = np.take_along_axis(near, top, 1)
        weight = np.where(close > 0, np.exp(self.sharp * (close - 1)), 0).astype(np.float64)
        little = 1e-6
        return ((weight * self.labels[top]).sum(1) + little * self.prior) / (weight.sum(1) + little)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 4000, **options) -> Model:
    """documents(doc_id, text), labels(doc_id, label): the bounded sample that the model is fitted on is at most
    max_labelled rows of SIZE half-precision numbers."""
    spark = documents.sparkSession
    small_batches(spark, 500)
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    sample = taught.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))

    def scan(batches):
        for batch in batches:
            rows = features(*utf8_parts(batch.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("y"), batch.column("doc_id")], names=["row", "y", "doc_id"])

    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    found = chosen.select("least.text", "y", "doc_id").mapInArrow(scan, "row binary, y double, doc_id long").collect()
    found.sort(key=lambda r: r.doc_id)
    rows = np.array([np.frombuffer(r.row, np.float16) for r in found], np.float32).reshape(-1, SIZE)
    return Model(rows, np.array([r.y for r in found], np.float64), **options)


def scores(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents(doc_id, text, ...): doc_id, score and the columns of keep."""
    spark = documents.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    columns = ["doc_id", *(c for c in keep if c != "doc_id")]
    kinds = dict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:]).dtypes)

    def scan(batches):
        for batch in batches:
            found = shared.value.score(features(*utf8_parts(batch.column("__text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.clip(found, 0, 1))], names=[*columns, "score"])

    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:], text_or_empty().cast("binary").alias("__text"))
    return picked.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double")


def accepted(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score is the threshold or more."""
    spark = documents.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            raw, off = utf8_parts(pc.fill_null(batch.column("text"), ""))
            yield batch.filter(pa.array(shared.value.score(features(raw, off)) >= threshold))

    return documents.mapInArrow(scan, documents.schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether crc32 of the doc_id, as text, leaves no remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))
