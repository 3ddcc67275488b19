"""Exact removal of repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Only the first ``depth`` bytes (50) of a suffix matter, so two suffixes are equal to that depth exactly if they begin a
repeated window. Sorting every suffix of the corpus would move eight times its bytes; so the passes go from coarse
digits to fine ones, and what is alone under a digit is dropped before the next:

1. Every window is rotated so that its *anchor* - the leftmost gram of ``gram`` bytes with the smallest hash - comes
   first. Anchors depend on the window's bytes only, so equal windows agree on theirs. Some windows in a row share one
   anchor: one entry (gram hash, hash of all the bytes these windows cover, document, place) stands for them.
   Digit 1 is the gram's hash, and the shuffle deals entries out by its leading bits. Within a block of documents
   equal entries are merged first, so one hot line costs an entry a block.
2. Digit 2 is the hash of the covered bytes, 128 bits with digit 1: equal ones make all windows of the later documents
   repeats. Runs of copied text end here.
3. For what is left (edges of copied runs) the covered bytes themselves are sent, and the windows are sorted digit by
   digit, eight bytes at a time, down to the full depth. The equal groups are exactly the repeated windows.

No pass lists the pairs of a group: only the smallest document of each group counts.

Defined results: a null text counts as empty; a text shorter than ``depth`` loses nothing; rows with the same doc_id
never make each other's bytes repeats; rows with a null doc_id come after all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import (
    BASE, BYTE_WORDS, Scratch, gram_hash, mix64, run_starts, shuffle_parts, sliding_min, small_batches, spread,
    text_or_empty, utf8_parts,
)

CHUNK = 1 << 17
#: Bytes of text whose entries a map task merges before it sends them.
BLOCK_BYTES = 12 << 20
#: Stored bytes of documents in a part, and bytes of windows that a task gathers before it sends them.
PART_BYTES, FETCHED_BYTES = 8 << 20, 16 << 20
NO_ID = (1 << 63) - 1
U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def windows_by_anchor(raw: np.ndarray, off: np.ndarray, depth: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, context hash, first window, last window, anchor) for each anchor; places are in raw."""
    n, reach = len(raw), depth - gram + 1
    up, down = _powers(min(n, CHUNK + depth) + 1)
    short = np.maximum(off[:-1], off[1:] - depth + 1)
    for a in range(0, n - depth + 1, CHUNK):
        b = min(a + CHUNK, n - depth + 1)
        part = raw[a : b + depth - 1]
        words = BYTE_WORDS[part]
        grams = mix64(gram_hash(words, gram))
        place = np.arange(len(grams), dtype=U)
        low = sliding_min((grams & ~U(0xFFFFF)) | place, reach) & U(0xFFFFF)
        ok = np.ones(b - a, bool)
        i, j = np.searchsorted(off[1:], a, "right"), np.searchsorted(short, b, "left")
        for s, e in zip(np.maximum(short[i:j] - a, 0).tolist(), (off[i + 1 : j + 1] - a).tolist(), strict=True):
            ok[s:e] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        anchors = low[at]
        first = run_starts(anchors, at - np.arange(len(at)))
        last = np.append(first[1:], len(at)) - 1
        s, e, g = at[first], at[last], anchors[first].astype(np.int64)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(words * up[: len(part)], out=sums[1:])
        context = mix64((sums[e + depth] - sums[s]) * down[s] + (e - s).astype(U) * U(0x94D049BB133111EB))
        yield mix64(grams[g] + U(1)), context, s + a, e + a, g + a  # scrambled anew: anchors have small hashes


def _pack(x: np.ndarray, kind) -> bytes:
    """Bytes in planes: the planes of small numbers are zeros, which the shuffle's compression takes away."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpack(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _hits(kind_of, parts: int, ids, marks, starts, runs, grams=None) -> Iterator[dict]:
    """Rows (part of the documents, places); kind_of: the table that they go to."""
    to = _part_of(ids, marks, parts)
    order = np.argsort(to, kind="stable")
    bounds = np.append(run_starts(to[order]), len(to))
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        o = order[x:y]
        yield {"bucket": kind_of, "part": int(to[o[0]]), "ids": _pack(ids[o], "<i8"), "marks": _pack(marks[o], "<i8"), "starts": _pack(starts[o], "<i4"), "runs": _pack(runs[o], "<i4"), "grams": b"" if grams is None else _pack(grams[o], "<u8")}


def _part_of(ids: np.ndarray, marks: np.ndarray, parts: int) -> np.ndarray:
    return (ids ^ marks) % parts


class _Block:
    """Entries of some documents, merged and sent by bucket."""

    def __init__(self, depth: int, gram: int, buckets: int, parts: int):
        self.depth, self.gram, self.buckets, self.parts = depth, gram, buckets, parts
        self.found, self.ids, self.marks, self.size = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        raw, off = utf8_parts(batch.column("text"))
        base = sum(map(len, self.ids))
        self.ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        self.marks.append(batch.column("mark").to_numpy(zero_copy_only=False))
        self.size += len(raw)
        for grams, context, s, e, _ in windows_by_anchor(raw, off, self.depth, self.gram):
            doc = np.searchsorted(off, s, "right") - 1
            self.found.append((grams, context, (doc + base).astype(np.int32), (s - off[doc]).astype(np.int32), (e - s).astype(np.int32)))

    def rows(self) -> Iterator[dict]:
        if self.found:
            grams, context, doc, start, run = (np.concatenate(x) for x in zip(*self.found, strict=True))
            ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
            order = np.lexsort((ids[doc], context, grams))
            grams, context, doc, start, run = (x[order] for x in (grams, context, doc, start, run))
            first = run_starts(grams, context)
            own = ids[doc]
            least = np.repeat(own[first], np.diff(np.append(first, len(own))))
            late = own > least
            if late.any():
                yield from _hits(-1, self.parts, own[late], marks[doc[late]], start[late], run[late])
            keep = ~late
            grams, context, doc, start, run = (x[keep] for x in (grams, context, doc, start, run))
            to = _bucket(grams, self.buckets)
            bounds = np.append(run_starts(to), len(to))
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                known, index = np.unique(doc[x:y], return_inverse=True)
                yield {"bucket": int(to[x]), "grams": _pack(np.diff(grams[x:y], prepend=U(0)), "<u8"), "contexts": context[x:y].tobytes(), "docs": _pack(index, "<u4"), "ids": _pack(ids[known], "<i8"), "marks": _pack(marks[known], "<i8"), "starts": _pack(start[x:y], "<i4"), "runs": _pack(run[x:y], "<u1")}
        self.__init__(self.depth, self.gram, self.buckets, self.parts)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The leading digit of the sort: ranges of the gram's hash."""
    return ((grams >> U(33)) * U(buckets) >> U(31)).astype(np.int64)


def _table(rows: list[dict], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in names], names=[n for n, _ in names])


def _send(rows: Iterator[dict], names: list[tuple[str, pa.DataType]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size > most:
            yield _table(held, names)
            held, size = [], 0
    if held:
        yield _table(held, names)


B = pa.binary()
SENT = [("bucket", pa.int32()), ("part", pa.int32()), ("grams", B), ("contexts", B), ("docs", B), ("ids", B), ("marks", B), ("starts", B), ("runs", B)]
SENT_SQL = "bucket int, part int, grams binary, contexts binary, docs binary, ids binary, marks binary, starts binary, runs binary"
#: Where rows of the second digit go: found repeats, and windows still to be sorted.
REPEAT, OPEN = -1, -2


def _second_digit(table: pa.Table, parts: int) -> Iterator[dict]:
    cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for r in table.to_pylist():
        doc = _unpack(r["docs"], "<u4")
        got = (np.cumsum(_unpack(r["grams"], "<u8"), dtype=U), np.frombuffer(r["contexts"], U), _unpack(r["ids"], "<i8")[doc], _unpack(r["marks"], "<i8")[doc], _unpack(r["starts"], "<i4"), _unpack(r["runs"], "<u1").astype(np.int32))
        for c, x in zip(cols, got, strict=True):
            c.append(x)
    grams, context, ids, marks, start, run = (np.concatenate(x) for x in cols)
    cols.clear()
    order = np.argsort(grams)
    grams, context, ids, marks, start, run = (x[order] for x in (grams, context, ids, marks, start, run))
    first = run_starts(grams)
    length = np.diff(np.append(first, len(grams)))
    least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    alive = np.repeat(least < most, length)  # what is alone under the digit goes
    if not alive.any():
        return
    grams, context, ids, marks, start, run = (x[alive] for x in (grams, context, ids, marks, start, run))
    order = np.lexsort((ids, context, grams))
    grams, context, ids, marks, start, run = (x[order] for x in (grams, context, ids, marks, start, run))
    first = run_starts(grams, context)
    own = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
    repeat = ids > own
    yield from _hits(REPEAT, parts, ids[repeat], marks[repeat], start[repeat], run[repeat])
    rest = ~repeat  # of each context, the places in its smallest document
    grams, context, ids, marks, start, run = (x[rest] for x in (grams, context, ids, marks, start, run))
    first = run_starts(grams)
    length = np.diff(np.append(first, len(grams)))
    alive = np.repeat(np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), length) if len(grams) else np.zeros(0, bool)
    if alive.any():
        yield from _hits(OPEN, parts, ids[alive], marks[alive], start[alive], run[alive], grams[alive])


def _by_document(table: pa.Table) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    cols = [[], [], [], [], []]
    for r in table.to_pylist():
        got = [_unpack(r["ids"], "<i8"), _unpack(r["marks"], "<i8"), _unpack(r["starts"], "<i4"), _unpack(r["runs"], "<i4")]
        got.append(_unpack(r["grams"], "<u8") if r["grams"] else np.zeros(len(got[0]), U))
        for c, x in zip(cols, got, strict=True):
            c.append(x)
    if not cols[0]:
        return {}
    ids, marks, starts, runs, grams = (np.concatenate(x) for x in cols)
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts, runs, grams = (x[order] for x in (ids, marks, starts, runs, grams))
    bounds = np.append(run_starts(ids, marks), len(ids))
    return {(int(ids[x]), int(marks[x])): (starts[x:y], runs[x:y], grams[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)}


CONTEXTS = [("bucket", pa.int32()), ("part", pa.int32()), ("grams", B), ("contexts", B), ("ids", B), ("marks", B), ("starts", B), ("runs", B)]
CONTEXTS_SQL = "bucket int, part int, grams binary, contexts binary, ids binary, marks binary, starts binary, runs binary"


def _beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found, packed, and then the documents of each part, in one order: a task holds what was found for one part
    and a batch of documents, however long the texts are."""
    packed = found.select("part", F.lit(0).alias("kind"), "ids", "marks", "starts", "runs", "grams")
    texts = docs.select("part", F.lit(1).alias("kind"), "doc_id", "mark", "text")
    return packed.unionByName(texts, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Batches of documents, each with what was found for its part."""
    part, held, found = None, [], {}
    for batch in batches:
        of, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        bounds = np.append(run_starts(of, kind), len(of))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if of[x] != part:
                part, held, found = of[x], [], None
            if kind[x] == 0:
                held.append(batch.slice(x, y - x))
                continue
            if found is None:
                found, held = _by_document(pa.Table.from_batches(held)) if held else {}, []
            yield found, batch.slice(x, y - x)


def _fetch(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[dict]:
    """The bytes of the open windows, by the gram's bucket."""
    cols: list[list] = [[], [], [], [], [], []]
    size = 0
    for want, batch in _parts(batches):
        raw, off = utf8_parts(batch.column("text"))
        for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)):
            if key not in want:
                continue
            starts, runs, grams = want.pop(key)  # once for rows with the same id and text
            places, _ = spread(starts + off[i], runs + depth)
            n = len(starts)
            for c, x in zip(cols, (grams, np.full(n, key[0]), np.full(n, key[1]), starts, runs, raw[places]), strict=True):
                c.append(x)
            size += len(places)
        if size >= FETCHED_BYTES:
            yield from _by_bucket(cols, depth, buckets)
            cols, size = [[], [], [], [], [], []], 0
    if cols[0]:
        yield from _by_bucket(cols, depth, buckets)


def _by_bucket(cols: list[list], depth: int, buckets: int) -> Iterator[dict]:
    grams, ids, marks, starts, runs, body = (np.concatenate(x) for x in cols)
    to = _bucket(grams, buckets)
    order = np.argsort(to, kind="stable")
    size = runs + depth
    begin = np.cumsum(size) - size
    bounds = np.append(run_starts(to[order]), len(to))
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        o = order[x:y]
        yield {"bucket": int(to[o[0]]), "part": 0, "grams": _pack(grams[o], "<u8"), "contexts": body[spread(begin[o], size[o])[0]].tobytes(), "ids": _pack(ids[o], "<i8"), "marks": _pack(marks[o], "<i8"), "starts": _pack(starts[o], "<i4"), "runs": _pack(runs[o], "<i4")}


#: Windows that one step of the last passes holds.
STEP = 1 << 20


def _last_digits(table: pa.Table, depth: int, parts: int) -> Iterator[dict]:
    cols: list[list] = [[], [], [], [], [], []]
    for r in table.to_pylist():
        for c, x in zip(cols, (_unpack(r["grams"], "<u8"), _unpack(r["ids"], "<i8"), _unpack(r["marks"], "<i8"), _unpack(r["starts"], "<i4"), _unpack(r["runs"], "<i4"), np.frombuffer(r["contexts"], np.uint8)), strict=True):
            c.append(x)
    grams, ids, marks, starts, runs, body = (np.concatenate(x) for x in cols)
    body = np.append(body, np.zeros(8, np.uint8))
    begin = np.cumsum(runs + depth) - (runs + depth)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = run_starts(grams)
    load = np.add.reduceat(runs[order] + 1, first) if len(first) else first
    step = (np.cumsum(load) - 1) // STEP
    cuts = np.append(first[run_starts(step)], len(order))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        o = order[x:y]
        place, of = spread(begin[o], runs[o] + 1)
        owner = o[of]
        group = np.repeat(np.arange(y - x), runs[o] + 1)
        group = np.searchsorted(first, group + x, "right")
        hit = repeated_windows(body, place, group, ids[owner], depth)
        if hit.any():
            w, own = place[hit], owner[hit]
            s = starts[own] + (w - begin[own])
            yield from _hits(REPEAT, parts, ids[own], marks[own], s.astype(np.int32), np.zeros(len(s), np.int32))


def repeated_windows(body: np.ndarray, place: np.ndarray, group: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Whether each window (depth bytes at its place) also begins in a smaller document of its group: passes over digits
    of eight bytes, most significant first; groups of one document drop out after each pass."""
    live = np.arange(len(place))
    for d in range(0, depth, 8):
        order = np.argsort(group, kind="stable")
        live, group = live[order], group[order]
        first = run_starts(group)
        if not len(first):
            break
        own = ids[live]
        alive = np.repeat(np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first), np.diff(np.append(first, len(own))))
        live, group = live[alive], group[alive]
        digit = np.zeros(len(live), U)
        for k in range(8):
            digit <<= U(8)
            if d + k < depth:
                digit |= body[place[live] + d + k].astype(U)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        number = np.zeros(len(live), np.int64)
        number[run_starts(group, digit)] = 1
        group = np.cumsum(number)
    hit = np.zeros(len(place), bool)
    if len(live):
        first = run_starts(group)
        own = ids[live]
        hit[live] = own > np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
    return hit


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], depth: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for found, batch in _parts(batches):
        raw, off = utf8_parts(batch.column("text"))
        out = []
        for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)):
            text = raw[off[i] : off[i + 1]]
            removed = spans = 0
            kept = text.tobytes()
            if key in found:
                starts, runs, _ = found[key]
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + runs + depth, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text[~gone].tobytes()
            out.append((None if key[0] == NO_ID else key[0], len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)


def _part_count(documents: DataFrame) -> int:
    """Parts of the documents: by stored bytes, as the plan states them, so packed rows don't multiply where there are
    more partitions than the input fills; a partition each where the input is larger than that."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(shuffle_parts(documents.sparkSession), -(-size // PART_BYTES)))


def remove_repeats(documents: DataFrame, depth: int = 50, gram: int = 24, keep_text: bool = True) -> DataFrame:
    """documents(doc_id, text): each byte of a ``depth``-byte string that also starts in a document with a smaller doc_id
    goes. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, the kept bytes."""
    spark = documents.sparkSession
    if not 0 < gram <= depth or depth - gram > 255:
        raise ValueError("gram must be from 1 to depth, and at least depth - 255")
    small_batches(spark)
    parts = _part_count(documents)
    buckets = 4 * parts
    scratch = Scratch(spark, "suffix")
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().cast("binary").alias("text"), F.xxhash64(text_or_empty()).alias("mark"))

    def entries(batches):
        def rows():
            block = _Block(depth, gram, buckets, parts)
            for batch in batches:
                block.add(batch)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
            yield from block.rows()

        yield from _send(rows(), SENT)

    # Repeats within a block are known already; the other entries meet by their leading digit.
    sent = docs.mapInArrow(entries, SENT_SQL).withColumn("to", F.when(F.col("bucket") < 0, F.col("part")))
    second = scratch.table(sent.groupBy("bucket", "to").applyInArrow(lambda t: _relay(t, parts), SENT_SQL), "second")
    keyed = docs.withColumn("part", _part_sql(parts))
    wanted = second.where(F.col("bucket") == OPEN).select("part", "ids", "marks", "starts", "runs", "grams")
    contexts = _beside(keyed, wanted).mapInArrow(lambda x: _send(_fetch(x, depth, buckets), CONTEXTS), CONTEXTS_SQL)
    last = scratch.table(contexts.groupBy("bucket").applyInArrow(lambda t: _as_table(_last_digits(t, depth, parts), SENT), SENT_SQL), "last")
    hits = second.where(F.col("bucket") == REPEAT).unionByName(last).select("part", "ids", "marks", "starts", "runs", "grams")
    done = _beside(keyed, hits).mapInArrow(lambda x: _cut(x, depth, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")


def _part_sql(parts: int):
    return F.pmod(F.col("doc_id").bitwiseXOR(F.col("mark")), F.lit(parts)).cast("int")


def _relay(table: pa.Table, parts: int) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        return table.select([n for n, _ in SENT])
    return _as_table(_second_digit(table, parts), SENT)


def _as_table(rows: Iterator[dict], names: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_batches(list(_send(rows, names)), pa.schema(names))
