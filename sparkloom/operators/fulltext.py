"""A full-text index: postings (term, doc_id, positions) in partitions by the hash of the term.

Terms are the runs of letters and digits of a text, A-Z in lower case. A query reads the partitions of its own terms and no
others. Documents are dealt out to ``slices`` by the hash of their ids, which grow in number with their texts. Texts are
shuffled once, to their slice; its postings are made, written and joined with each other there, as blocks: a row for a term
and some documents of a slice, so that no task holds all of a term's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a slice at most, about.
SLICE = 200_000
#: Bytes of the texts of a slice, about, and those whose postings a task holds at a time.
SLICE_BYTES = 8 << 20
#: Slices that a task writes, where there are many.
TOGETHER = 4
#: Texts whose postings a task holds at a time.
TEXTS = 5000

_IN_TERMS = np.isin(np.arange(256), np.frombuffer(f"{UPPER}{LOWER}0123456789".encode(), np.uint8))
_LOWERED = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())), np.uint8)


def terms(text: Column) -> Column:
    """The terms of a text in their order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ in some column from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of texts (bytes) one after the other, the text of each and its place in it."""
    ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(), dtype=np.int64)])
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    inside = _IN_TERMS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]  # a text's term doesn't go on from the text before
    begins[first] = inside[first]
    letters = _LOWERED[data[inside]]
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    at = np.flatnonzero(begins)
    text = np.searchsorted(ends, at, side="right") - 1
    return found, text, np.arange(len(at)) - np.searchsorted(at, ends[:-1])[text]


def _blocks_of(part: int, doc_ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """A row for each term of some texts of a slice: the documents that hold it, ascending, and its positions in each."""
    found, text, place = _tokens(texts)
    coded = found.dictionary_encode()
    code, doc = coded.indices.to_numpy(), doc_ids[text]
    order = np.argsort(code, kind="stable") if len(_edges(doc_ids)) == len(doc_ids) else np.lexsort((place, doc, code))
    code, doc, place = code[order], doc[order], place[order].astype(np.int32)
    lists = _edges(code, doc)
    rows = _edges(code[lists])
    ends = pa.array(np.append(rows, len(lists)).astype(np.int32))
    positions = pa.ListArray.from_arrays(pa.array(np.append(lists, len(place)).astype(np.int32)), pa.array(place))
    named = coded.dictionary.take(pa.array(code[lists[rows]])).cast(pa.string())
    columns = [pa.array(np.full(len(rows), part, np.int32)), named, pa.ListArray.from_arrays(ends, pa.array(doc[lists])), pa.ListArray.from_arrays(ends, positions)]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "term", "doc_ids", "positions"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice, doc_id and text as bytes, sorted by slice and doc_id: the blocks of some documents of a slice at a time. The rows
    of a doc_id stay together."""
    kept: pa.Table | None = None

    def cut(rows: pa.Table, whole: int) -> Iterator[pa.RecordBatch]:
        part, doc_ids, texts = rows["slice"].to_numpy(), rows["doc_id"].to_numpy(), rows["text"]
        documents = _edges(part[:whole], doc_ids[:whole])
        size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(), dtype=np.int64)])
        starts = [*documents[_edges(part[documents], size[documents] // SLICE_BYTES, documents // TEXTS)].tolist(), whole]
        for a, b in pairwise(starts):
            yield _blocks_of(int(part[a]), doc_ids[a:b], pa.concat_arrays(texts.slice(a, b - a).chunks))

    for batch in batches:
        if len(batch):
            some = pa.Table.from_batches([batch])
            some = some if kept is None else pa.concat_tables([kept, some])
            whole = int(_edges(some["slice"].to_numpy(), some["doc_id"].to_numpy())[-1])
            yield from cut(some, whole)
            kept = some.slice(whole)  # the last document may go on in the next batch
    if kept is not None:
        yield from cut(kept, len(kept))


def blocks(documents: DataFrame, buckets: int = 64, slice_rows: int = SLICE) -> DataFrame:
    """documents(doc_id, text): bucket, slice, term, doc_ids, positions, where the lists of a row go together."""
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows, size = named.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    slices = max(1, -(-rows // slice_rows), -(-(size or 0) // SLICE_BYTES))
    tasks = min(slices, max(-(-slices // TOGETHER), documents.sparkSession.sparkContext.defaultParallelism))
    dealt = named.select(F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "text").repartitionById(tasks, "slice")
    made = dealt.sortWithinPartitions("slice", "doc_id").mapInArrow(_blocks, "slice int, term string, doc_ids array<long>, positions array<array<int>>")
    return made.select(bucket_of(F.col("term"), buckets).alias("bucket"), "slice", "term", "doc_ids", "positions")


def _flat(rows: DataFrame) -> DataFrame:
    """A row for each term and document of blocks."""
    return rows.select("bucket", "slice", "term", F.inline_outer(F.arrays_zip("doc_ids", "positions")).alias("doc_id", "positions"))


def postings(documents: DataFrame, buckets: int = 64, slice_rows: int = SLICE) -> DataFrame:
    """documents(doc_id, text): bucket, slice, term, doc_id, positions (from 0, ascending). Rows with the same doc_id are one
    document whose positions may repeat; a null doc_id has none. Postings are made where a slice's texts meet and not
    shuffled themselves."""
    return _flat(blocks(documents, buckets, slice_rows))


def _places(rows: pa.Table) -> pa.Table:
    """The blocks of a slice, each with what asks for its term: query_id, doc_id, hits."""
    doc_ids, positions = rows["doc_ids"].combine_chunks(), rows["positions"].combine_chunks().flatten()
    held = doc_ids.flatten().to_numpy()
    documents = np.unique(held)
    sizes = positions.value_lengths().to_numpy()
    keys = (np.repeat(np.searchsorted(documents, held), sizes) << 32) + positions.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(doc_ids.value_lengths().to_numpy(), dtype=np.int64)])]
    blocks_of: dict[str, list[int]] = {}
    for n, term in enumerate(rows["term"].to_pylist()):
        blocks_of.setdefault(term, []).append(n)
    places, asked = {}, {}
    for term, own in blocks_of.items():
        places[term] = np.unique(np.concatenate([keys[ends[n] : ends[n + 1]] for n in own]))
        for ask in rows["asks"][own[0]].as_py():
            asked.setdefault((ask["query_id"], ask["phrase"], ask["length"]), {})[ask["offset"]] = term
    found = []
    for (query_id, _, length), wanted in asked.items():
        if len(wanted) == length:
            (offset, term), *others = sorted(wanted.items(), key=lambda x: len(places[x[1]]))  # the rarest first
            at = places[term] - offset
            for offset, term in others:
                near = np.searchsorted(places[term], at + offset)
                at = at[places[term][np.minimum(near, len(places[term]) - 1)] == at + offset]
            found.append((query_id, *np.unique(at >> 32, return_counts=True)))
    found = [x for x in found if len(x[1])]
    ids = pa.array([q for q, d, _ in found for _ in d], rows.schema.field("asks").type.value_type.field("query_id").type)
    at, hits = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (1, 2))
    return pa.table([ids, pa.array(documents[at]), pa.array(hits)], names=["query_id", "doc_id", "hits"])


def write(documents: DataFrame, path: str, buckets: int = 64, slice_rows: int = SLICE) -> None:
    """Writes the index: a folder a bucket, in it files sorted by term, so that row groups of other terms are passed over."""
    blocks(documents, buckets, slice_rows).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        schema = "slice int, term string, doc_ids array<long>, positions array<array<int>>, bucket int"
        self.spark, self.buckets, self.rows = spark, buckets, spark.read.schema(schema).parquet(path)

    def of(self, words: list[str]) -> DataFrame:
        """The postings of some terms: only their partitions are read."""
        if not words:
            return _flat(self.rows.limit(0))
        own = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"), self.buckets)).distinct().collect()]
        return _flat(self.rows.where(F.col("bucket").isin(own) & F.col("term").isin(words)))

    def all_of(self, words: list[str]) -> DataFrame:
        """doc_id, hits: the documents that hold every term, and how often they hold them together."""
        words = sorted(set(words))
        found = self.of(words).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size("positions")).alias("hits"))
        return found.where(F.col("n") == len(words)).select("doc_id", "hits")

    def any_of(self, words: list[str]) -> DataFrame:
        """doc_id, hits: the documents that hold some term."""
        return self.of(sorted(set(words))).groupBy("doc_id").agg(F.sum(F.size("positions")).alias("hits"))

    def phrases(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, phrase): query_id, doc_id, hits, where a document holds the terms of a phrase one after the other.
        The index is joined with the terms of all queries, and a block goes once to its slice, however many ask for it. There
        the places of a query's rarest term are looked up among those of its others. A phrase without terms finds nothing."""
        named = queries.select("query_id", terms(F.col("phrase")).alias("terms")).select("query_id", F.xxhash64("terms").alias("phrase"), F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
        asks = named.groupBy("term").agg(F.collect_list(F.struct("query_id", "phrase", "length", "offset")).alias("asks")).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        met = self.rows.join(asks, ["bucket", "term"]).select("slice", "term", "doc_ids", "positions", "asks")
        found = met.groupBy("slice").applyInArrow(_places, f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, hits long")
        return found.groupBy("query_id", "doc_id").agg(F.sum("hits").alias("hits"))

    def ranked(self, words: list[str], documents: int) -> DataFrame:
        """doc_id, score: the documents with some term by the sum of (1 + ln tf) * ln(1 + documents / df)."""
        rows = self.of(sorted(set(words))).select("term", "doc_id", F.size("positions").alias("tf"))
        frequency = rows.groupBy("term").agg(F.count("*").alias("df"))
        weighed = rows.join(F.broadcast(frequency), "term")  # a row for each word of the query at most
        return weighed.groupBy("doc_id").agg(F.sum((1 + F.log("tf")) * F.log(1 + documents / F.col("df"))).alias("score"))
