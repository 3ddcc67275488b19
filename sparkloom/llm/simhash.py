"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some word lies within r bits of both. So every fingerprint emits
all words of its ball of radius r (2081 of 64 bits for r = 2), and equal words meet. Sending each word would move
8 * 2081 bytes a document, so the emission is split in two: ``lead`` leading bits are varied before the shuffle (a
fingerprint goes to 1 + lead + lead * (lead - 1) / 2 buckets), and the remaining flips of the radius are spent on the
other bits within the bucket, which is split by its next bits where it holds too many words. Every word of every ball is still made exactly once.

Words that meet link all their fingerprints, each pair of which is verified by its Hamming distance to the first; as a
star is enough for the component, no pairs of a group are listed. Equal fingerprints are merged first.

Defined results: null texts count as empty; texts without words have fingerprint zero and link like any other; equal
texts get equal rows; a null doc_id is kept as a row and never names a component unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, run_starts, small_batches, text_or_empty
from sparkloom.llm.graph import components

U = np.uint64
#: Words that a bucket holds at a time, and bits by which a larger one is split.
STEP_WORDS, SPLIT_BITS = 1 << 21, 6


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, of lower-cased A-Z; of fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(line[a:b], 42) for a, b in spans], U)


def simhash(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the hashes of the word shingles; one shingle's bits are its hash."""
    return majority(shingle_hashes(text, shingle))


#: For each byte, its bits as counters of 8 bits in a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(U).ravel()


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    n, total = len(hashes), np.zeros((8, 8), np.int64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for a in range(0, n, 255):
        total += np.add.reduce(_SPREAD[lanes[a : a + 255]], axis=0).view(np.uint8).reshape(8, 8)
    return int.from_bytes(np.packbits(total.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    small_batches(documents.sparkSession)

    def scan(batches):
        for batch in batches:
            found = [simhash(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, U).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def masks(bits: range, most: int) -> list[int]:
    """All words with at most ``most`` of the bits set."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def meetings(found: np.ndarray, bucket: int, lead: int, radius: int, width: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """Where words of the balls of the fingerprints sent to a bucket meet: members of the groups, where each group begins,
    and its length. A bucket with too many words is split by its next bits, which shares them out, each word in one part."""
    todo = [(np.arange(len(found)), bucket, lead)]
    while todo:
        own, bucket, lead = todo.pop()
        low = width - lead
        spent = np.bitwise_count((found[own] >> U(low)) ^ U(bucket)) if lead else np.zeros(len(own), np.uint8)
        if len(own) < 2:
            continue
        left_over = np.bincount(spent, minlength=radius + 1)[: radius + 1]
        total = sum(int(n) * sum(comb(low, k) for k in range(radius - j + 1)) for j, n in enumerate(left_over))
        if total > STEP_WORDS and low > SPLIT_BITS:
            ahead = found[own] >> U(low - SPLIT_BITS)
            for part in range(1 << SPLIT_BITS):
                near = np.bitwise_count(ahead ^ U(bucket << SPLIT_BITS | part)) <= radius
                todo.append((own[near], bucket << SPLIT_BITS | part, lead + SPLIT_BITS))
            continue
        tails = found[own] & U((1 << low) - 1)
        words, owners = [], []
        for k in range(radius + 1):
            o = np.flatnonzero(spent == k)
            flips = np.array(masks(range(low), radius - k), U)
            words.append((tails[o][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(own[o], len(flips)))
        w, of = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(w)
        w, of = w[order], of[order]
        first = run_starts(w)
        length = np.diff(np.append(first, len(w)))
        many = length > 1
        if many.any():
            met = np.repeat(many, length)
            length = length[many]
            yield of[met], np.cumsum(length) - length, length


def ball_links(found: np.ndarray, bucket: int, lead: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints sent to a bucket of leading bits: a forest that spans each group that meets."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    left, right = [], []
    for of, first, length in meetings(found, bucket, lead, radius):
        head, tail = np.repeat(of[first], length), of
        close = (head != tail) & (np.bitwise_count(found[head] ^ found[tail]) <= distance)
        pairs = np.unique(np.stack((np.minimum(head, tail), np.maximum(head, tail)), 1)[close], axis=0)
        for a, b in pairs.tolist():
            if (p := find(a)) != (q := find(b)):
                root[max(p, q)] = min(p, q)
                left.append(a)
                right.append(b)
    return found[left].view(np.int64), found[right].view(np.int64)


def near_links(prints: DataFrame, lead: int, distance: int = 4) -> DataFrame:
    """prints(fp), distinct. Returns links a, b that connect exactly what chains of small distances connect."""
    radius = distance // 2
    leads = np.array(masks(range(lead), radius), U)

    def emit(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(U)
            to = ((fp >> U(64 - lead))[:, None] ^ leads[None, :]) if lead else np.zeros((len(fp), 1), U)
            order = np.argsort(to.ravel(), kind="stable")
            key, all_fp = to.ravel()[order], np.repeat(fp, to.shape[1])[order]
            bounds = np.append(run_starts(key), len(key))
            rows = [(int(key[x]), all_fp[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "fps"])

    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table.column("fps").to_pylist()), U)
        a, b = ball_links(np.unique(found), table.column("bucket")[0].as_py(), lead, radius, distance)
        return pa.table([pa.array(a), pa.array(b)], schema=names)

    return prints.mapInArrow(emit, "bucket long, fps binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """documents(doc_id, text). Returns doc_id, fp (long) and component_id, the smallest doc_id that chains of
    fingerprints with at most ``distance`` differing bits (an even number) reach."""
    scratch = Scratch(documents.sparkSession, "simhash")
    rows = scratch.table(fingerprints(documents, shingle), "prints")
    prints = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Leading bits so that a bucket's own share of fingerprints stays near a thousand, whatever the input.
    lead = min(24, max(6, (max(1, prints.count()) >> 10).bit_length()))
    links = scratch.table(near_links(prints.select("fp").repartition("fp"), lead, distance), "links")
    roots = components(links, scratch)
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = scratch.table(named.join(smallest, "root").select("fp", "component_id"), "classes")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")
