"""Benchmark passages in documents: randomised edit embedding, bit-sampling LSH and exact edit verification.

A walk (see cgk) begins at every word of an item and of a document. Its bands, samples of the walk's steps, tolerate edits;
where a document's band word equals an item's, the item may lie there, and the two places give the item-sized window. Each
window is proposed by every word of the passage, in every band, so a passage at the least likeness is found with high
probability: one needs proposals from different words within the window's slack, one for each ``WORDS_A_VOTE`` words of
the item and ``votes`` at least (about one word in four proposes at the least likeness). Windows so found pass a filter
that loses none (edit distance of pieces of 64 characters, all windows at once) and are verified by the exact least edit
distance between the item and any substring of the window, in one scan from left to right.

Items too short for walks to find them surely (under ``sure_words`` words, or fewer than ``votes`` whole walks) are proposed
by an exact rule as well: of k + 1 pieces of an item with k edits one is left as it was, so every place of a piece is a
proposal. Items of fewer than ``least_words`` words are too short to allow edits: they are found word for word.

Equal items are one item with several names, and the places of an item with one band word are one proposal. Long texts are
read in segments that overlap by an item, and proposals are made for a bounded number of places at a time, so memory is
bounded by the items and not by texts or repetition. Items go to the executors as plain text, in blocks of at most
``block_bytes``, each block in a pass of its own: the tables (about 25 bytes for each byte of text) are built there, and
one block is held at a time.

Defined results: null texts count as empty; Latin-1 capitals and white space are folded; null items and items without words
are never reported (a script without spaces counts each character as a word); repeated rows and a null doc_id are reported
like others; a repeated passage is reported at each place, and places of an item don't overlap.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.cgk import Walks, code_points
from sparkloom.llm.common import Scratch, gram_hash, run_starts, small_batches, text_or_empty

U = np.uint64
#: Characters read at a time, and proposals made at a time.
SEGMENT, PROPOSALS = 1 << 21, 1 << 21
WORDS_A_VOTE = 10
FOLD = np.arange(0x250, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[0xC0:0xD7] += 32
FOLD[0xD8:0xDF] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64()), ("likeness", pa.float64())])
HITS_SQL = "doc_id long, item_id long, start long, end long, distance long, likeness double"


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, off = code_points(texts)
    return np.where(codes < len(FOLD), FOLD[np.minimum(codes, len(FOLD) - 1)], codes), off


def word_starts(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words begin; in scripts without spaces, every character."""
    solid = codes != 32
    first = np.ones(len(codes), bool)
    first[1:] = ~solid[:-1]
    edges = off[:-1][off[:-1] < len(codes)]
    first[edges] = True
    return np.flatnonzero(solid & (first | (codes >= 0x2E80)))


def least_edits(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance between the pattern and a substring of the text, and where that substring ends (the first
    of equals). Bit-parallel dynamic programming: a column a step."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = where.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(h | plus)), plus & h
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces_fit(patterns: list[np.ndarray], which: np.ndarray, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, rate: float) -> np.ndarray:
    """Whether a substring of window i, codes[begins[i]:ends[i]], can be patterns[which[i]] with edits at the rate: then the
    least distances of its pieces, of at most 64 characters each, have no greater sum. All windows take their columns
    together; characters are compared by six bits, which can only make distances smaller."""
    edits, length = np.zeros(len(which), np.int64), np.array([len(p) for p in patterns], np.int64)
    for c in range(0, len(which), 1 << 14):
        used, own = np.unique(which[c : c + (1 << 14)], return_inverse=True)
        count = np.array([-(-len(patterns[i]) // 64) for i in used])
        lows = [(p & 63).astype(np.int64) for i, n in zip(used, count, strict=True) for p in np.array_split(patterns[i], n)]
        size = np.array([len(p) for p in lows])
        where = np.zeros((len(lows), 64), U)
        for i, p in enumerate(lows):
            np.bitwise_or.at(where[i], p, U(1) << np.arange(len(p), dtype=U))
        n = count[own]
        window = np.repeat(np.arange(len(own)) + c, n)
        piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(count) - count)[own], n)
        order = np.argsort(begins[window] - ends[window], kind="stable")  # the longest windows first
        window, piece = window[order], piece[order]
        at, span, top = begins[window], ends[window] - begins[window], (size[piece] - 1).astype(U)
        score = size[piece].copy()
        least = score.copy()
        plus, minus = np.full(len(piece), ~U(0)), np.zeros(len(piece), U)
        active = np.searchsorted(-span, -np.arange(span[0] if len(span) else 0), "left")
        for j, k in enumerate(active.tolist()):
            v, m = plus[:k], minus[:k]
            eq = where[piece[:k], (codes[at[:k] + j] & 63).astype(np.int64)]
            x = eq | m
            h = (((eq & v) + v) ^ v) | eq
            up, down = m | ~(h | v), v & h
            score[:k] += (up >> top[:k] & U(1)).astype(np.int64) - (down >> top[:k] & U(1)).astype(np.int64)
            up, down = up << U(1), down << U(1)
            plus[:k], minus[:k] = down | ~(x | up), up & x
            np.minimum(least[:k], score[:k], out=least[:k])
        np.add.at(edits, window, least)
    return edits <= rate * length[which] if len(which) else np.zeros(0, bool)


def gram_classes(codes: np.ndarray) -> np.ndarray:
    low = codes.astype(np.int64) & 31
    return np.bincount((low[:-2] * 32 + low[1:-1]) % 64 * 32 + low[2:], minlength=2048) if len(codes) > 2 else np.zeros(2048, np.int64)


def places(pattern: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of substrings within ``most`` edits of the pattern, from left to right, none overlapping. Of
    the ends in reach of each other the nearest counts. The scan goes on from each end anew, so its length is linear."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    codes, out, begin, n = text.tolist(), [], 0, len(text)
    while begin < n:
        plus, minus, score, best, end = full, 0, m, most + 1, -1
        for j in range(begin, n):
            eq = where.get(codes[j], 0)
            x = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(h | plus)), plus & h
            score += bool(up & top) - bool(down & top)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(x | up)), up & x
            if score < best:
                best, end = score, j + 1
            elif end >= 0 and j + 1 - end > most:
                break
        if end < 0:
            break
        distance, back = least_edits(pattern[::-1], text[max(begin, end - m - most) : end][::-1])
        out.append((end - back, end, distance))
        begin = max(end, begin + 1)
    return out


class _Words:
    """A sorted table of words (hashes), each with its item and the first and last of places there that the slack joins."""

    def __init__(self, words: np.ndarray, items: np.ndarray, at: np.ndarray, slack: np.ndarray):
        order = np.lexsort((at, items, words))
        words, items, at = words[order], items[order], at[order]
        first = run_starts(words, items, np.cumsum(np.diff(at, prepend=at[:1]) > slack[items]))
        last = np.append(first[1:], len(words)) - 1
        self.words, self.items = words[first], items[first].astype(np.int32)
        self.low, self.high = at[first].astype(np.int32), at[last].astype(np.int32) if len(first) else at.astype(np.int32)
        self.bits = U(64 - min(24, max(20, (8 * len(first)).bit_length())))
        self.seen = np.zeros(1 << int(U(64) - self.bits), bool)
        self.seen[(self.words >> self.bits).astype(np.int64)] = True

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words are known, and the bounds of their rows."""
        at = np.flatnonzero(self.seen[(words >> self.bits).astype(np.int64)])
        low, high = np.searchsorted(self.words, words[at], "left"), np.searchsorted(self.words, words[at], "right")
        known = high > low
        return at[known], low[known], high[known]


class Items:
    """Folded items and the tables of their words. Pickled as plain text: the tables are made where they are used."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, least_words: int, sure_words: int, votes: int, seed: int):
        self.made_of, self.built = (rows, rate, least_words, sure_words, votes, seed), False

    def __getstate__(self):
        return self.made_of

    def __setstate__(self, made_of):
        self.made_of, self.built = made_of, False

    def _build(self) -> None:
        self.built = True
        rows, self.rate, least_words, sure_words, self.votes, seed = self.made_of
        self.walks = Walks(28, 10, 10, seed, sure=False)
        names: dict[bytes, list[int]] = {}
        codes, off = folded([t for _, t in rows])
        for i, (name, _) in enumerate(rows):
            own = codes[off[i] : off[i + 1]]
            if len(solid := np.flatnonzero(own != 32)):
                names.setdefault(own[solid[0] : solid[-1] + 1].tobytes(), []).append(name)
        self.codes, self.names = [np.frombuffer(k, np.uint32) for k in names], list(names.values())
        off = np.concatenate(([0], np.cumsum([len(c) for c in self.codes]))).astype(np.int64)
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        self.lengths = np.diff(off)
        self.slack = (self.rate * self.lengths).astype(np.int64) + 1
        starts = word_starts(codes, off)
        of = np.searchsorted(off, starts, "right") - 1
        n = len(self.codes)
        words = np.bincount(of, minlength=n)
        self.need = np.maximum(self.votes, words // WORDS_A_VOTE)
        whole = np.bincount(of[starts + self.walks.steps <= off[of + 1]], minlength=n)
        wide = (words >= least_words)[of]
        keys = self.walks.keys(codes, starts[wide], off[of[wide] + 1]) if wide.any() else np.zeros((0, self.walks.bands), U)
        self.bands = [_Words(keys[:, b], of[wide], starts[wide] - off[of[wide]], self.slack) for b in range(self.walks.bands)]
        unsure = np.flatnonzero((words >= least_words) & ((words < sure_words) | (whole < self.votes)))
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i in unsure.tolist():
            count = int(self.rate * len(self.codes[i])) + 1
            cuts = np.linspace(0, len(self.codes[i]), count + 1).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pieces.setdefault(b - a, []).append((i, a))
        self.pieces = {size: self._grams(size, at) for size, at in pieces.items() if size}
        exact: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(words < least_words).tolist():
            exact.setdefault(len(self.codes[i]), []).append((i, 0))
        self.exact = {size: self._grams(size, at) for size, at in exact.items()}
        self.reach = int((self.lengths + 2 * self.slack).max()) if n else 0

    def _grams(self, size: int, at: list[tuple[int, int]]) -> _Words:
        words = np.array([gram_hash(self.codes[i][a : a + size].astype(U) + U(1), size)[0] for i, a in at], U)
        return _Words(words, np.array([i for i, _ in at]), np.array([a for _, a in at]), self.slack)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int, float]]:
        """(row, item, start, end, distance, likeness) of every verified place."""
        if not self.built:
            self._build()
        if not self.codes:
            return []
        found: set[tuple] = set()
        for rows, bases, parts in self._segments(texts):
            for row, item, a, b, distance in self._find(parts):
                found.add((rows[row], item, a + bases[row], b + bases[row], distance))
        return [(r, name, a, b, d, 1 - d / len(self.codes[i])) for r, i, a, b, d in self._apart(found) for name in self.names[i]]

    def _segments(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """Texts that have SEGMENT characters together at most; a longer one in parts that overlap by the longest reach."""
        step = max(SEGMENT, 4 * self.reach)
        rows, bases, parts, size = [], [], [], 0
        for i, text in enumerate(texts):
            a = 0
            while True:
                part = text[a : a + step] if a or len(text) > step else text
                if rows and size + len(part) > step:
                    yield rows, bases, parts
                    rows, bases, parts, size = [], [], [], 0
                rows.append(i)
                bases.append(a)
                parts.append(part)
                size += len(part)
                if a + step >= len(text):
                    break
                cut = a + step - self.reach
                while cut > a + step // 2 and text[cut - 1] not in " \t\n\v\f\r":
                    cut -= 1
                a = cut
        if rows:
            yield rows, bases, parts

    def _find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        codes, off = folded(texts)
        if not len(codes):
            return
        starts = word_starts(codes, off)
        ends = off[np.searchsorted(off, starts, "right")]
        keys = self.walks.keys(codes, starts, ends)
        windows = [self._windows(starts, [(b, *b.matches(keys[:, i])) for i, b in enumerate(self.bands)], off, self.need)]
        place = np.arange(len(codes))
        solid = codes.astype(U) + U(1)
        for size, table in self.pieces.items():
            if len(codes) >= size:
                at, low, high = table.matches(gram_hash(solid, size))
                inside = place[at] + size <= off[np.searchsorted(off, place[at], "right")]
                windows.append(self._windows(place, [(table, at[inside], low[inside], high[inside])], off, np.ones(len(self.codes), np.int64)))
        row, item, low, high = (np.concatenate(x) for x in zip(*windows, strict=True))
        row, item, low, high = _merged(row, item, low, high)
        # Long windows are cut for the filter, so that each part overlaps the next by all that a place can take.
        length = self.lengths[item]
        reach = length + self.slack[item]
        count = np.maximum(1, -(-(high - low - reach) // (2 * reach)))
        of = np.repeat(np.arange(len(row)), count)
        begin = low[of] + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * 2 * reach[of]
        end = np.minimum(high[of], begin + 3 * reach[of])
        fit = pieces_fit(self.codes, item[of], codes, begin, end, self.rate)
        for r, i, a, b in zip(*(x.tolist() for x in _merged(row[of][fit], item[of][fit], begin[fit], end[fit])), strict=True):
            pattern, most = self.codes[i], int(self.rate * len(self.codes[i]))
            common = int(np.minimum(gram_classes(pattern), gram_classes(codes[a:b])).sum())
            if b - a >= len(pattern) - most and common >= len(pattern) - 2 - 3 * most:  # an edit changes three trigrams at most
                base = int(off[r])
                for s, e, d in places(pattern, codes[a:b], most):
                    yield r, i, s + a - base, e + a - base, d
        for size, table in self.exact.items():
            at = starts[starts + size <= ends]
            after = at + size
            done = after == off[np.searchsorted(off, at, "right")]
            whole = done | (codes[np.minimum(after, len(codes) - 1)] == 32) | (codes[after - 1] >= 0x2E80) if len(at) else done
            at = at[whole]
            if not len(at):
                continue
            k, low, high = table.matches(gram_hash(solid, size)[at])
            for p, x, y in zip(at[k].tolist(), low.tolist(), high.tolist(), strict=True):
                r = int(np.searchsorted(off, p, "right")) - 1
                for i in table.items[x:y].tolist():
                    if np.array_equal(self.codes[i], codes[p : p + size]):
                        yield r, i, p - int(off[r]), p + size - int(off[r]), 0

    def _windows(self, place: np.ndarray, matched: list[tuple], off: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, begin, end) of windows with proposals from as many places as the item needs; a bounded number of proposals at a time,
        with the places of an item's reach before them."""
        load = np.zeros(len(place), np.int64)
        for _, at, low, high in matched:
            load[at] += high - low
        total = np.cumsum(load)
        out, a = [], 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PROPOSALS, "right")))
            back = int(np.searchsorted(place, place[a] - self.reach, "left"))
            if total[min(b, len(place)) - 1] > (total[back - 1] if back else 0):
                out.append(self._grouped(place, matched, off, need, back, b))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def _grouped(self, place, matched, off, need: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
        found = []
        for table, at, low, high in matched:
            x, y = np.searchsorted(at, first), np.searchsorted(at, last)
            at, low, count = at[x:y], low[x:y], (high - low)[x:y]
            own = np.repeat(np.arange(len(at)), count)
            which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            where = place[at][own]
            found.append((np.searchsorted(off, where, "right") - 1, table.items[which].astype(np.int64), where - table.high[which], where - table.low[which], where))
        row, item, low, high, where = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((low, item, row))
        row, item, low, high, where = (x[order] for x in (row, item, low, high, where))
        group = _overlapping(row, item, low, high + self.slack[item])
        order = np.lexsort((where, group))
        new = np.zeros(len(row), bool)
        new[run_starts(group[order], where[order])] = True
        head = run_starts(group)
        enough = np.add.reduceat(new, run_starts(group[order])) >= need[item[head]] if len(head) else np.zeros(0, bool)
        far = np.maximum.reduceat(high, head) if len(head) else high
        row, item, low, high = row[head][enough], item[head][enough], low[head][enough], far[enough]
        return row, item, np.maximum(low - self.slack[item], off[row]), np.minimum(high + self.lengths[item] + self.slack[item], off[row + 1])

    def _apart(self, found: set[tuple]) -> list[tuple]:
        """Of places of an item that overlap in a row, the nearest one."""
        kept: dict[tuple[int, int], list[tuple]] = {}
        for row, item, a, b, distance in sorted(found, key=lambda h: (h[0], h[1], h[4], h[2], h[3])):
            own = kept.setdefault((row, item), [])
            k = bisect_left(own, (a, b))
            if (k == 0 or own[k - 1][1] <= a) and (k == len(own) or own[k][0] >= b):
                insort(own, (a, b, distance))
        return sorted((*key, *hit) for key, hits in kept.items() for hit in hits)


def _overlapping(row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number for each group of intervals of one row and item that touch; sorted by row, item and low."""
    if not len(row):
        return np.zeros(0, np.int64)
    key = np.zeros(len(row), np.int64)
    key[run_starts(row, item)] = 1
    key = np.cumsum(key) - 1
    span = int(high.max() - low.min()) + 2
    reach = np.maximum.accumulate(high - low.min() + key * span) - key * span + low.min()  # the farthest end so far
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] > reach[:-1])
    return np.cumsum(new) - 1


def _merged(row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of one row and item that overlap, as one."""
    order = np.lexsort((low, item, row))
    row, item, low, high = row[order], item[order], low[order], high[order]
    head = run_starts(_overlapping(row, item, low, high))
    return row[head], item[head], low[head], np.maximum.reduceat(high, head) if len(head) else high


class Leaks:
    """Finds passages of benchmark(item_id, text) that a document has with a likeness of ``likeness`` or more."""

    def __init__(self, benchmark: DataFrame, likeness: float = 0.8, least_words: int = 5, sure_words: int = 15, votes: int = 2, block_bytes: int = 4 << 20, seed: int = 23):
        self.spark = benchmark.sparkSession
        self.settings = 1 - likeness + 1e-9, least_words, sure_words, votes, seed
        self.items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null").distinct()
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = range(max(1, -(-total // block_bytes)))

    def _block(self, k: int):
        """A block of the items, broadcast as text; equal texts are in one block."""
        part = self.items.where(F.pmod(F.xxhash64("text"), F.lit(len(self.blocks))) == k) if len(self.blocks) > 1 else self.items
        return self.spark.sparkContext.broadcast(Items(sorted(((r.item_id, r.text) for r in part.collect()), key=str), *self.settings))

    def hits(self, documents: DataFrame) -> DataFrame:
        """A row for each place: doc_id, item_id, start, end (code points), distance (edits), likeness."""
        small_batches(documents.sparkSession, 500)
        docs = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        scratch, out = Scratch(self.spark, "leaks"), None
        for k in self.blocks:
            block = self._block(k)

            def scan(batches, block=block):
                for batch in batches:
                    ids = batch.column("doc_id").to_pylist()
                    if found := block.value.find(batch.column("text").to_pylist()):
                        columns = list(zip(*((ids[f[0]], *f[1:]) for f in found), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)

            part = docs.mapInArrow(scan, HITS_SQL)
            if len(self.blocks) > 1:
                part = scratch.table(part, "hits")
                block.unpersist()
            out = part if out is None else out.unionByName(part)
        return out

    def without(self, documents: DataFrame) -> DataFrame:
        """The documents, all columns, that have no such passage."""
        small_batches(documents.sparkSession, 500)
        scratch = Scratch(self.spark, "leaks")
        for k in self.blocks:
            block = self._block(k)

            def scan(batches, block=block):
                for batch in batches:
                    texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
                    clean = np.ones(len(texts), bool)
                    clean[[f[0] for f in block.value.find(texts)]] = False
                    yield batch.filter(pa.array(clean))

            documents = documents.mapInArrow(scan, documents.schema)
            if len(self.blocks) > 1:
                documents = scratch.table(documents, "clean")
                block.unpersist()
        return documents
