"""MinHash near-duplicates: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

A text's set holds the hashes of its distinct word shingles. Sorted, their leading eight bits deal them to 256 bins, and the
first of each bin is its minimum: one pass over one permutation. An empty bin takes the value of the first bin with one in
a fixed random order of its own, so a bin still agrees between two texts with probability of their Jaccard similarity.
``BANDS`` words of ``ROWS`` bins each are buckets: a pair at 0.8 shares one but for three chances in a million.

Candidates stay near linear in the texts, and yet no link is lost:

1. Equal sets are one class, buckets with equal members are one bucket.
2. Stars: in a bucket every class is a candidate of the bucket's smallest class only. Each class is confirmed against the
   head that its sketch (a byte a bin) is nearest to: one pair a class at most. What is confirmed makes components.
3. Buckets whose members are in several components: every pair of different components is looked at where the bucket lies,
   unless their sketches rule it out (``NEAR`` agreeing bins, five deviations under 0.8), on sets of four bytes a shingle:
   these can only make a pair look nearer than it is. One component of a bucket, the largest, is compared with the others
   only; tasks hold at most some ``QUERIES`` classes against ``HELD`` others, and send on a forest of what they find. Pairs
   themselves, whose number may be the square of a family's, are never rows.

All candidates of either step are confirmed on their full sets. Should one of the forests of step 3 fail there, the step
is repeated with all that it finds instead of forests, so no link hides behind the one that failed.

Defined results: texts without words are linked with nothing and are their own component; texts with fewer words than a
shingle have one, of all their words; equal sets are linked. A null doc_id never names a component unless all of it are
null, and a row is kept if its doc_id is the component's, both null included. Rows with equal doc_ids are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, mix64, random_words, small_batches, text_or_empty
from sparkloom.llm.graph import components
from sparkloom.llm.near_copies import standing
from sparkloom.llm.simhash import shingle_hashes

U = np.uint64
BINS, BANDS, ROWS = 256, 42, 6
#: Agreeing bins of BINS from which a pair is confirmed on its sets.
NEAR = 169
QUERIES, HELD = 256, 1024
EDGES = np.arange(BINS, dtype=U) << U(56)
BAND_WORDS = random_words(53, BANDS)


@lru_cache(maxsize=8)
def probes(k: int) -> np.ndarray:
    """The order in which each empty bin looks for a value, a column a look: its first 16 looks, the next 240, then 4096 at a
    time."""
    first, n = ((0, 16), (16, 240))[k] if k < 2 else (256 + 4096 * (k - 2), 4096)
    at = np.arange(first, first + n, dtype=U)[None, :] * U(BINS) + np.arange(BINS, dtype=U)[:, None]
    return (mix64(mix64(at + U(0x9E3779B97F4A7C15))) >> U(56)).astype(np.uint8)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified minima of sorted distinct hashes, at least one."""
    at = np.searchsorted(hashes, EDGES)
    full = np.append(at[1:], len(hashes)) > at
    out = np.zeros(BINS, U)
    out[full] = hashes[at[full]]
    empty, k = np.flatnonzero(~full), 0
    while len(empty):
        looks = probes(k)[empty]
        hit = full[looks]
        at = hit.argmax(axis=1)
        row = np.arange(len(empty))
        got = hit[row, at]
        out[empty[got]] = out[looks[row[got], at[got]]]
        empty, k = empty[~got], k + 1
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """The buckets of a signature: a word for each band."""
    words = BAND_WORDS.copy()
    for k in range(ROWS):
        words = mix64(words ^ mix64(minima[k : BANDS * ROWS : ROWS] + U(k)))
    return words.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.string()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, mark (MD5 of the text), text as bytes."""
    text = text_or_empty().cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("mark"), text.alias("text"))


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    """For each document the size and digest of its set, a byte of each minimum, and its buckets; null without words."""
    small_batches(documents.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                if len(hashes):
                    minima = signature(hashes)
                    rows.append((len(hashes), hashlib.md5(hashes.tobytes()).digest(), minima.astype(np.uint8).tobytes(), bands(minima)))
                else:
                    rows.append((0, None, None, None))
            columns = [batch.column("doc_id"), batch.column("mark"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SIGNED)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=SIGNED)

    return keyed(documents).mapInArrow(scan, "doc_id long, mark string, n_shingles long, digest binary, sketch binary, bands array<long>")


def buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, head, size of the members of buckets with several classes; of buckets with equal members one."""
    members = classes.select("id", F.explode("bands").alias("key"))
    prints = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(2)]
    met = members.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size"), *prints).where("size > 1")
    one = scratch.table(met.groupBy("head", "size", "p0", "p1").agg(F.min("key").alias("key")).select("key", "head", "size"), "buckets")
    return scratch.table(members.join(one, "key"), "members")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) with the bins in which their sketches agree, if these are NEAR or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bins", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
            bins = (x == y).sum(axis=1)
            near = pa.array(bins >= NEAR)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bins)], schema=schema).filter(near)

    one = classes.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    other = classes.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(scan, "a long, b long, bins long")


class Meeting:
    """Classes of a bucket, some of which ask: links of those that ask to classes of other components."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], merged: np.ndarray, percent: int):
        self.ids, self.roots, self.sketches, self.sets, self.percent = ids, roots.copy(), sketches, sets, percent
        #: Shingles that share their four bytes with another of the set: so many might be missing from an intersection.
        self.merged = merged

    def alike(self, q: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may have the similarity."""
        own, parts = self.sets[q], [self.sets[i] for i in others.tolist()]
        size = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)
        spare = np.minimum(self.merged[q], self.merged[others])
        union = len(own) + self.merged[q] + size + self.merged[others] - both - spare
        return 100 * (both + spare) >= self.percent * union

    def links(self, asks: np.ndarray, held: np.ndarray, thin: bool) -> np.ndarray:
        """Pairs (smaller id, larger id); if thin, only those that join components here for the first time."""
        out = []
        for q in asks.tolist():
            bins = (self.sketches[held] == self.sketches[q]).sum(axis=1)
            near = np.flatnonzero((bins >= NEAR) & (self.roots[held] != self.roots[q]))
            near = held[near[np.argsort(-bins[near], kind="stable")]]
            for k in range(0, len(near), 128):
                some = near[k : k + 128]
                some = some[self.roots[some] != self.roots[q]]
                if not len(some):
                    continue
                for i in some[self.alike(q, some)].tolist():
                    if thin and self.roots[i] == self.roots[q]:
                        continue
                    out.append((min(self.ids[q], self.ids[i]), max(self.ids[q], self.ids[i])))
                    if thin:
                        self.roots[self.roots == self.roots[q]] = self.roots[i]
        return np.array(out, np.int64).reshape(-1, 2)


def short_sets(ids: DataFrame, documents: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """id, short (the four lowest bytes of the shingles' hashes, sorted, once each), merged (how many fell together)."""
    schema = pa.schema([("id", pa.int64()), ("short", pa.binary()), ("merged", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(text, shingle))
                short = np.unique(hashes.astype(np.uint32))
                rows.append((i, short.tobytes(), len(hashes) - len(short)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts_of(ids, documents, classes).mapInArrow(scan, "id long, short binary, merged long")


def between(members: DataFrame, documents: DataFrame, classes: DataFrame, roots: DataFrame, scratch: Scratch, shingle: int, percent: int, thin: bool) -> DataFrame:
    """a, b (a < b): links between members of a bucket in different components, to be confirmed."""
    rooted = members.join(roots, "id", "left").select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "root")).alias("most")).where("kinds > 1")
    open_ = scratch.table(rooted.join(mixed.select("key", F.col("most.root").alias("main"), F.col("most.n").alias("mains")), "key"), "open")
    sets = scratch.table(short_sets(open_.select("id").distinct(), documents, classes, shingle).join(classes.select("id", "sketch"), "id"), "sets")
    chunks, parts = (F.ceil(n / k).cast("int") for n, k in ((F.col("size") - F.col("mains"), QUERIES), (F.col("size"), HELD)))
    drawn = F.xxhash64("id")
    held = open_.select("key", "id", "root", F.lit(False).alias("asks"), F.pmod(drawn, parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    asks = open_.where("root <> main").select("key", "id", "root", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.pmod(drawn, chunks).cast("int").alias("chunk"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        asking = table.column("asks").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        short = [np.frombuffer(x, np.uint32) for x in table.column("short").to_pylist()]
        met = Meeting(table.column("id").to_numpy(), table.column("root").to_numpy(), sketches, short, table.column("merged").to_numpy(), percent)
        pairs = np.unique(met.links(np.flatnonzero(asking), np.flatnonzero(~asking), thin), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return asks.unionByName(held).join(sets, "id").groupBy("key", "chunk", "part").applyInArrow(meet, "a long, b long").distinct()


def texts_of(ids: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """ids(id): id and the text, as bytes, of a document of each class."""
    wanted = ids.join(classes, "id").select("id", F.col("doc_id").alias("own"), F.col("mark").alias("of"))
    found = keyed(documents).join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("of")))
    return found.groupBy("id").agg(F.any_value("text").alias("text"))


def confirmed(pairs: DataFrame, documents: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets have the similarity."""
    texts = scratch.table(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), documents, classes), "texts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                x, y = (np.unique(shingle_hashes(v, shingle)) for v in (s, t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    one, other = texts.select(F.col("id").alias("a"), F.col("text").alias("s")), texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "s", "t").mapInArrow(scan, "a long, b long")


def linked(documents: DataFrame, scratch: Scratch, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and the classes of equal sets: id, digest, doc_id and mark of the first row, and root, the class that
    names the component. NEAR and the bands are made for a percentage of 80 or more."""
    if percent < 80:
        raise ValueError("the bands are made for 80 percent or more")
    rows = scratch.table(signatures(documents, shingle), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    merged = rows.where("n_shingles > 0").groupBy("digest").agg(first, F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"))
    # the numbers are fixed where the table is written
    classes = scratch.table(merged.select(F.monotonically_increasing_id().alias("id"), "digest", "first.doc_id", "first.mark", "sketch", "bands"), "classes")
    members = buckets(classes, scratch)
    stars = agreeing(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), classes)
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("bins", "a")).alias("a")).select("a", "b")
    links = scratch.table(confirmed(scratch.table(nearest, "nearest"), documents, classes, scratch, shingle, percent), "links")
    roots = scratch.table(components(links, scratch).select(F.col("node").alias("id"), "root"), "roots")
    for thin in (True, False):
        rest = scratch.table(between(members, documents, classes, roots, scratch, shingle, percent, thin), "between")
        more = scratch.table(confirmed(rest, documents, classes, scratch, shingle, percent), "more")
        links = links.unionByName(more)
        roots = scratch.table(components(links, scratch).select(F.col("node").alias("id"), "root"), "roots")
        if more.count() == rest.count():
            break
    named = classes.select("id", "digest", "doc_id", "mark").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rows, named


def near_duplicates(documents: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """documents(doc_id, text). Returns doc_id, n_shingles, component_id (the smallest doc_id that chains of links reach)
    and kept."""
    scratch = Scratch(documents.sparkSession, "minhash")
    rows, named = linked(documents, scratch, shingle, percent)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_digest = scratch.table(named.join(least, "root").select("digest", "component_id"), "named")
    named = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(by_digest, "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that stand for their group of near copies. Other than above, texts without words are
    copies of each other, and of the rows of a doc_id only one stays."""
    scratch = Scratch(documents.sparkSession, "copies")
    rows, named = linked(documents, scratch, shingle, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("mark").alias("digest"))).alias("first")
    least = named.groupBy("root").agg(first).select("first")
    wordless = rows.where("n_shingles = 0").groupBy("n_shingles").agg(first).select("first")
    return standing(documents, least.unionByName(wordless).select(F.col("first.doc_id").alias("own"), F.col("first.digest").alias("of")), scratch)
