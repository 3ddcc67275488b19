"""Cross-tokenizer alignment by dense count matrices in stripes of ids.

Two tokenizers cut the same bytes. Tokens whose byte ranges overlap are linked; how often two ids are linked in the corpus
says which id of the one answers to an id of the other, and how well a document's own links agree with that.

1. Blocks. A task gathers documents up to ``BLOCK_BYTES`` of text, encodes each piece of text that a space cuts off once,
   and keeps the block: for each document its pieces, for each piece its links as places in the block's list of distinct
   id pairs. The counts of that list leave by stripes of B ids, so a hot id costs a number a block.
2. Stripes. All counts of a stripe are added into one dense matrix (B ids of the stripe by all A ids); the maximum of a row
   is the best of that B id.
3. Scores. A stripe's matrix goes back over the blocks' lists where they lie, by stripe and range of blocks, and the
   answers meet their block, whose links are summed by document.

Neither tokenizer joins what stands on both sides of a space that follows something else than white space, so pieces are
encoded alone and remembered by the worker (``REMEMBERED`` of them at most). Where a vocabulary has tokens across such
places, whole texts are the pieces.

Defined results: null, empty and differently decoded texts have no tokens: zeros and an empty digest; they add nothing to
the counts. Rows with equal or null doc_ids are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, run_starts, small_batches, text_or_empty

#: Bytes of text of a block; entries of a stripe's matrix; pieces that a worker remembers; blocks answered together.
BLOCK_BYTES, MATRIX, REMEMBERED, TOGETHER = 8 << 20, 1 << 23, 250_000, 1024
#: Longest piece that is remembered, in characters.
SHORT = 64
TOKENIZERS = "/opt/tokenizers"
SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
EDGE = re.compile(r"(?<=\S) ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, all others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, the bytes of their tokens, and what pieces were encoded to lately."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(alphabet.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a_size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.space = self.b.piece_to_id(SPACE)  # a space at a text's end leaves an empty piece, which would get no space of its own
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        by_space = told["normalizer"] is None and (told["pre_tokenizer"] or {}).get("type") == "ByteLevel" and told["pre_tokenizer"]["use_regex"]
        self.by_space = by_space and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; a space before each is not named."""
        return EDGE.split(text) if self.by_space else [text]

    def aligned(self, pieces: list[str]) -> list[tuple]:
        """For each piece (A tokens, B tokens, groups, groups in writing, pairs b * a_size + a of all links), or zeros where
        the bytes of its tokens aren't the piece."""
        found = []
        for p in pieces:
            if (x := self.young.get(p)) is None and (x := self.old.get(p)) is not None:
                self.young[p] = x
            found.append(x)
        new = [i for i, x in enumerate(found) if x is None]
        texts = [pieces[i] for i in new]
        for at in range(0, len(new), 2000):
            part = texts[at : at + 2000]
            a = self.a.encode_batch_fast([" " + p for p in part], add_special_tokens=False)
            for i, p, x, y in zip(new[at : at + 2000], part, a, self.b.encode(part, num_threads=1), strict=True):
                found[i] = self._align(p, x.ids, y if p else [self.space])
                if len(p) <= SHORT:
                    self.young[p] = found[i]
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        return found

    def _align(self, piece: str, a: list[int], b: list[int]) -> tuple:
        raw = b" " + piece.encode()
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return 0, 0, 0, "", None
        size, groups, links = self.a_size, [], []
        i = j = i0 = j0 = x = y = 0  # x, y: where the tokens i and j end
        x, y = len(a_parts[0]), len(b_parts[0])
        while True:
            links.append(b[j] * size + a[i])
            if x == y:
                groups.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0 : j + 1]))}")
                i0 = i = i + 1
                j0 = j = j + 1
                if i == len(a):
                    break
                x, y = x + len(a_parts[i]), y + len(b_parts[j])
            elif x < y:
                i += 1
                x += len(a_parts[i])
            else:
                j += 1
                y += len(b_parts[j])
        return len(a), len(b), len(groups), ";".join(groups), np.array(links, np.int64)


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(a_path: str, b_path: str) -> Encoders:
    """The encoders of this worker."""
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Encoders(a_path, b_path)
    return _encoders[a_path, b_path]


def planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as planes of bytes, which compress well where numbers are small."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers(blob: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: stripe -1: the block itself; others: what the block counted for a stripe.
BLOCK = pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.string())), ("written", pa.list_(pa.string())), ("figures", pa.binary()), ("sizes", pa.binary()), ("seen", pa.binary()), ("spans", pa.binary()), ("places", pa.binary())])
BLOCK_DDL = "block long, stripe int, codes binary, counts binary, ids array<long>, hashes array<string>, written array<string>, figures binary, sizes binary, seen binary, spans binary, places binary"


def encoded_block(block: int, ids: list, texts: list[str], enc: Encoders, width: int, groups: bool) -> pa.RecordBatch:
    """Rows of BLOCK for some documents."""
    known: dict[str, int] = {}
    put = known.setdefault
    of = [np.array([put(p, len(known)) for p in enc.pieces(t)], np.int32) if t else np.zeros(0, np.int32) for t in texts]
    found = enc.aligned(list(known))
    figures = np.array([(x[0], x[1], x[2], 0 if x[4] is None else len(x[4])) for x in found], np.int64).reshape(-1, 4)
    bad = np.array([x[4] is None for x in found], bool)
    of = [np.zeros(0, np.int32) if bad[x].any() else x for x in of]
    size = np.array([len(x) for x in of], np.int64)
    seen = np.concatenate([np.zeros(0, np.int32), *of])
    wrote = [x[3] for x in found]
    written, hashes = [] if groups else None, []
    for x in of:
        w = ";".join([wrote[i] for i in x.tolist()])
        hashes.append(hashlib.sha256(w.encode()).hexdigest() if w else "")
        if groups:
            written.append(w)
    times = np.bincount(seen, minlength=len(found))
    spans = np.where(times > 0, figures[:, 3], 0)  # pieces of documents without tokens only count for nothing
    links = np.concatenate([np.zeros(0, np.int64), *(x[4] for x, n in zip(found, spans.tolist(), strict=True) if n)])
    pairs, places = np.unique(links, return_inverse=True)
    counts = np.bincount(places, np.repeat(times, spans), len(pairs)).astype(np.int64)
    stripe = pairs // (width * enc.a_size)
    firsts = run_starts(stripe)
    ends = np.cumsum(size)
    per_doc = np.zeros((len(of), 4), np.int64)
    for k in range(4):  # a column at a time: a block has millions of pieces
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(figures[:, k][seen])))
        per_doc[:, k] = upto[ends] - upto[ends - size]
    rows = [(block, -1, None, None, ids, hashes, written, planes(per_doc.ravel()), planes(size), planes(seen), planes(spans), planes(places))]
    for x, y in zip(firsts, [*firsts[1:], len(pairs)][: len(firsts)], strict=True):
        k = int(stripe[x])
        rows.append((block, k, planes(pairs[x:y] - k * width * enc.a_size), planes(counts[x:y]), *[None] * 8))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)


def blocks_of(documents: DataFrame, a_path: str, b_path: str, width: int, groups: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = encoders(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES or len(ids) >= 100_000:
                    yield encoded_block(part << 32 | made, ids, texts, enc, width, groups)
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield encoded_block(part << 32 | made, ids, texts, enc, width, groups)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, BLOCK_DDL)


TOTAL = pa.schema([("stripe", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def stripe_totals(counted: DataFrame, a_size: int, width: int) -> DataFrame:
    """counted(stripe, codes, counts). One row a stripe: its pairs in order, their counts, and which are their B id's highest."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, stripe = np.zeros(width * a_size, np.int64), None
        for batch in batches:
            stripe = batch.column("stripe")[0].as_py()
            for codes, counts in zip(batch.column("codes"), batch.column("counts"), strict=True):
                np.add.at(dense, numbers(codes.as_py()), numbers(counts.as_py()).astype(np.int64))
        most = dense.reshape(width, a_size).max(axis=1)
        codes = np.flatnonzero(dense)
        counts = dense[codes]
        best = np.packbits(counts == most[codes // a_size])
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((stripe, planes(codes), planes(counts, "<u8"), best.tobytes()), TOTAL, strict=True)], schema=TOTAL)

    return counted.groupBy("stripe").applyInArrow(add, "stripe int, codes binary, counts binary, best binary")


ANSWER = pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("counts", pa.binary()), ("best", pa.binary())])


def answers(totals: DataFrame, counted: DataFrame, blocks: int) -> DataFrame:
    """For each list of a block in counted, the corpus counts of its pairs and which are best, in its order. Dealt by
    stripe and range of blocks, so that a task holds one stripe's totals and streams the lists past them."""
    parts = max(1, blocks // TOGETHER)
    heads = totals.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("block"), "codes", "counts", "best")
    lists = counted.select("stripe", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block", "codes", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts = best = None
        for batch in batches:
            rows: list[tuple] = []
            for stripe, block, own, count, top in zip(*(batch.column(c) for c in ("stripe", "block", "codes", "counts", "best")), strict=True):
                if block.as_py() is None:
                    codes, counts = numbers(own.as_py()), numbers(count.as_py(), "<u8")
                    best = np.unpackbits(np.frombuffer(top.as_py(), np.uint8), count=len(codes))
                    continue
                at = np.searchsorted(codes, numbers(own.as_py()))
                rows.append((block.as_py(), stripe.as_py(), planes(counts[at], "<u8"), best[at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANSWER, strict=True)], schema=ANSWER)

    dealt = heads.unionByName(lists).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(look_up, "block long, stripe int, counts binary, best binary")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def scored(blocks: DataFrame, answered: DataFrame) -> DataFrame:
    """The rows of all documents: each block with its answers, which come first and in the order of its pairs."""
    own = ["ids", "hashes", "written", "figures", "sizes", "seen", "spans", "places"]
    last = 1 << 30
    both = answered.select("block", "stripe", "counts", "best", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in own])
    both = both.unionByName(blocks.select("block", F.lit(last).alias("stripe"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"), *own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                if get("stripe") != last:
                    counts.append(numbers(get("counts"), "<u8").astype(np.int64))
                    best.append(np.frombuffer(get("best"), np.uint8).astype(np.int64))
                    continue
                figures, size, seen, spans, places = (numbers(get(c)).astype(np.int64) for c in ("figures", "sizes", "seen", "spans", "places"))
                link_sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate(x)[places]))) for x in (best, counts)]
                ends = np.cumsum(spans)
                piece_sums = [s[ends] - s[ends - spans] for s in link_sums]
                doc = np.repeat(np.arange(len(size)), size)
                totals = np.zeros((len(size), 2), np.int64)
                np.add.at(totals, doc, np.stack(piece_sums, 1)[seen])
                columns = [pa.array(get("ids"), pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in figures.reshape(-1, 4).T), *(pa.array(np.ascontiguousarray(c)) for c in totals.T), pa.array(get("hashes"), pa.string()), pa.array(get("written") or [None] * len(size), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])
                counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    dealt = both.repartition("block").sortWithinPartitions("block", "stripe")
    return dealt.mapInArrow(score, SCORED)


class Alignment:
    """The alignment of a documents table (doc_id, text) between the byte-level tokenizer at a_path and the piece model at
    b_path. ``groups=True`` keeps the groups of each document in writing beside their digest."""

    def __init__(self, documents: DataFrame, a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", groups: bool = False):
        small_batches(documents.sparkSession, 500)
        enc = encoders(a_path, b_path)  # for the vocabularies' sizes
        self.a_size, self.width = enc.a_size, max(1, MATRIX // enc.a_size)
        self.scratch = Scratch(documents.sparkSession, "alignment")
        self.blocks = self.scratch.table(blocks_of(documents, a_path, b_path, self.width, groups), "blocks", "zstd")
        self.counted = self.blocks.where("stripe >= 0").select("block", "stripe", "codes", "counts")
        self.totals = self.scratch.table(stripe_totals(self.counted, self.a_size, self.width), "totals", "zstd")

    def pairs(self) -> DataFrame:
        """b_id, a_id, links, best: the linked id pairs of the corpus, their counts, and whether they are the B id's highest."""
        a_size, width = self.a_size, self.width
        schema = pa.schema([("b_id", pa.int64()), ("a_id", pa.int64()), ("links", pa.int64()), ("best", pa.bool_())])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, codes, counts, best in zip(*(batch.column(c) for c in ("stripe", "codes", "counts", "best")), strict=True):
                    code = numbers(codes.as_py()).astype(np.int64)
                    top = np.unpackbits(np.frombuffer(best.as_py(), np.uint8), count=len(code)).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(stripe.as_py() * width + code // a_size), pa.array(code % a_size), pa.array(numbers(counts.as_py(), "<u8").astype(np.int64)), pa.array(top)], schema=schema)

        return self.totals.mapInArrow(rows, "b_id long, a_id long, links long, best boolean")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless asked for)."""
        whole = self.blocks.where("stripe < 0")
        answered = self.scratch.table(answers(self.totals, self.counted, whole.count()), "answers", "zstd")
        return scored(whole, answered)
