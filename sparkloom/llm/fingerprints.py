"""Document fingerprints from randomised edit embeddings.

Walks (see cgk) begin at places that the text itself chooses, about every 14 characters, so an edit changes the walks
near it and no others. Each walk reads on past the next place, or to the end, so every character is read. Their band words, sampled steps of each walk, form the document's set; the fingerprint holds for
each of 128 slots one byte of the slot's smallest word, so the Hamming distance of two fingerprints in bytes falls as
their sets agree. Likeness is the share of the text that two documents have in common, estimated from it: with J the
corrected share of equal bytes, 2J / (1 + J). Candidates for near pairs come from bands of sampled bytes, and are
verified by the distance of the whole fingerprints.

Defined results: null texts count as empty; the fingerprint of an empty text is all zeros, and its likeness to another
empty text is 1; a null doc_id comes before all others in the order of documents; rows with equal doc_id are ordered by
text; a single document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.cgk import Walks, code_points, walk_starts
from sparkloom.llm.common import Scratch, mix64, shuffle_parts, small_batches, text_or_empty

U = np.uint64
#: A run of SPACING grams has GRAM + SPACING - 1 = 32 characters, which a walk of 64 steps surely reads: none is left out.
SLOTS, GRAM, SPACING = 128, 6, 27
FIRST_ID = -(1 << 63)


def sketch(texts: list[str], walks: Walks) -> np.ndarray:
    """A row of SLOTS bytes for each text."""
    codes, off = code_points(texts)
    n = len(texts)
    most = np.iinfo(np.uint64).max
    least = np.full(n * SLOTS, most, U)
    if len(codes):
        starts, of = walk_starts(codes, off, GRAM, SPACING)
        words = walks.keys(codes, starts, off[of + 1])
        for b in range(walks.bands):
            w = words[:, b]
            np.minimum.at(least, of * SLOTS + (w & U(SLOTS - 1)).astype(np.int64), w >> U(8))
    least = least.reshape(n, SLOTS)
    full = least != most
    # An empty slot takes the next full one's word, scrambled by the way to it.
    twice = np.concatenate((full, full), 1)
    place = np.where(twice, np.arange(2 * SLOTS), 2 * SLOTS)
    donor = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :SLOTS]
    far = donor - np.arange(SLOTS)
    got = np.take_along_axis(least, donor % SLOTS, 1)
    out = (mix64(got + far.astype(U) * U(0x9E3779B97F4A7C15)) & U(255)).astype(np.uint8)
    out[~full.any(1)] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    share = (a == b).mean(-1)
    j = np.clip((share - 1 / 256) * 256 / 255, 0, 1)
    return 2 * j / (1 + j)


def fingerprints(documents: DataFrame, seed: int = 11) -> DataFrame:
    """documents(doc_id, text). Returns doc_id and fingerprint, as hexadecimal digits."""
    small_batches(documents.sparkSession, 500)

    def scan(batches):
        walks = Walks(seed=seed)
        for batch in batches:
            rows = sketch(batch.column("text").to_pylist(), walks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes().hex() for r in rows], pa.string())], names=["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, fingerprint string")


def near_pairs(prints: DataFrame, at_least: float = 0.8, bands: int = 32) -> DataFrame:
    """prints(doc_id, fingerprint). Pairs of classes of equal fingerprints with a likeness of at_least or more: a, b
    (smallest doc_id of each class) and likeness. A band is ``128 / bands`` sampled bytes; all classes with a band in
    common are linked to the band's first, and verified."""
    width = 2 * SLOTS // bands
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    banded = classes.select("id", "fingerprint", F.posexplode(F.array(*[F.substring("fingerprint", 1 + b * width, width) for b in range(bands)])).alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.min(F.struct("id", "fingerprint")).alias("head"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(heads, ["band", "key"]).where("id <> head.id").select("id", "fingerprint", "head").distinct()
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + F.when(F.substr(F.col("fingerprint"), i * 2 + 1, F.lit(2)) == F.substr(F.col("head.fingerprint"), i * 2 + 1, F.lit(2)), 1).otherwise(0))
    j = F.greatest(F.lit(0.0), (equal / SLOTS - 1 / 256) * 256 / 255)
    return pairs.select(F.col("head.id").alias("a"), F.col("id").alias("b"), (2 * j / (1 + j)).alias("likeness")).where(F.col("likeness") >= at_least)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """documents dealt into ranges of doc_id, in order; each range ends with a copy (is_copy) of what follows it: the
    first rows of the next range, and after the last those of the first."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"), text_or_empty().alias("text"))
    bounds = np.array(sorted({int(x) for x in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids):
        return ids.__class__(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    dealt = docs.withColumn("range", range_of("doc_id"))
    firsts = sorted((r["range"], r["first"]) for r in dealt.groupBy("range").agg(F.min("doc_id").alias("first")).collect())  # a row for each range
    after = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]
    small = spark.createDataFrame(after, "to int, first long")
    copies = docs.join(F.broadcast(small), F.col("doc_id") == F.col("first")).select("doc_id", "text", F.col("to").alias("range"))
    both = dealt.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))
    return both.repartition(ranges, "range").sortWithinPartitions("range", "is_copy", "doc_id", "text")


def edited_fingerprints(documents: DataFrame, seed: int = 11) -> DataFrame:
    """Fingerprints of documents(doc_id, text) and of their edited texts: the last floor(n / 2) code points replaced by
    the first as many (or all) of the next document. Columns as in RESULT."""
    spark = documents.sparkSession
    small_batches(spark, 500)

    def scan(batches):
        walks = Walks(seed=seed)
        held = None
        for batch in batches:
            keys, texts = list(zip(batch.column("range").to_pylist(), batch.column("is_copy").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)), batch.column("text").to_pylist()
            prints = sketch(texts, walks)
            if held:
                keys, texts, prints = [held[0], *keys], [held[1], *texts], np.concatenate((held[2][None], prints))
            own = [i for i in range(len(keys) - 1) if not keys[i][1]]
            edited = []
            for i in own:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            if own:
                new = sketch(edited, walks)
                here = np.array(own)
                columns = [
                    [None if keys[i][2] == FIRST_ID else keys[i][2] for i in own], [len(texts[i]) for i in own],
                    [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    [prints[i].tobytes().hex() for i in own], [r.tobytes().hex() for r in new],
                    likeness(prints[here], new), likeness(prints[here], prints[here + 1]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TYPES, strict=True)], schema=TYPES)
            held = keys[-1], texts[-1], prints[-1]

    return with_next(documents, 2 * shuffle_parts(spark)).mapInArrow(scan, RESULT)
