"""Vector search: exact scores by column expressions, blocked exact search for many queries, an inverted-file index, and the
stores and caches built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": (cosine, True), "dotproduct": (dot, True), "euclidean": (euclidean, False)}


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / size)


def check_dimensions(vectors: DataFrame, column: str = "embedding") -> int:
    """The one dimension of all vectors; raises if there are several."""
    found = [r[0] for r in vectors.where(F.size(column) > 0).groupBy(F.size(column)).count().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors have different dimensions: {sorted(found)}")
    return found[0] if found else 0


def top_k(vectors: DataFrame, query: list[float], k: int = 3, metric: str = "cosine", at_least: float | None = None, where: Column | None = None, id_column: str = "vec_id") -> DataFrame:
    """The k best rows for one query, filtered before they are ranked: one scan, and k rows a task."""
    score, larger = METRICS[metric]
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("score", score(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    if at_least is not None:
        scored = scored.where(F.col("score") >= at_least)
    return scored.orderBy(F.desc("score") if larger else F.asc("score"), id_column).limit(k)


def two_memories(semantic: DataFrame, procedural: DataFrame, query: list[float], k: tuple[int, int] = (8, 3)) -> DataFrame:
    parts = [top_k(d, query, n).withColumn("memory", F.lit(name)) for d, n, name in ((semantic, k[0], "semantic"), (procedural, k[1], "procedural"))]
    return parts[0].unionByName(parts[1])


#: Numbers of a block of query vectors that is sent to every task, and scores that a task holds at a time.
BLOCK, SCORES = 4_000_000, 2_000_000


class _Nearest:
    """The k best (query, vector, score) of all that was seen, by score and then by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.vector, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> None:
        query, vector, score = np.concatenate((self.query, query)), np.concatenate((self.vector, vector)), np.concatenate((self.score, score))
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        keep = rank < self.k
        self.query, self.vector, self.score = query[keep], vector[keep], score[keep]


def search_all(queries: DataFrame, vectors: DataFrame, k: int = 10, at_least: float | None = None) -> DataFrame:
    """queries(query_id, embedding), vectors(vec_id, embedding): the k nearest by cosine of every query, exact. Queries go in
    blocks of bounded size; each task multiplies its vectors with a block, a bounded number of scores at a time, and keeps
    k for each query, so the shuffle gets k rows for each query and task. With at_least and k = 0, all pairs that near."""
    spark = queries.sparkSession
    width = max(1, check_dimensions(queries))
    total = queries.count()
    blocks = max(1, -(-total * width // BLOCK))
    out = None
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else queries
        rows = part.select("query_id", "embedding").collect()
        ids = np.array([r[0] for r in rows], np.int64)
        block = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, width))
        size = np.linalg.norm(block, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, block / np.where(size == 0, 1, size)))

        def scan(batches, shared=shared):
            own, q = shared.value
            best = _Nearest(len(own), k)
            for rows in batches:
                if not len(rows) or not len(own):
                    continue
                v = np.stack(rows.embedding.to_numpy()).astype(np.float64)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v, at = v / np.where(length == 0, 1, length), rows.vec_id.to_numpy()
                step = max(1, SCORES // len(v))
                for a in range(0, len(own), step):
                    near = v @ q[a : a + step].T
                    if not k:
                        i, j = np.nonzero(near >= at_least)
                        yield pd.DataFrame({"query_id": own[a + j], "vec_id": at[i], "score": near[i, j]})
                        continue
                    cut = best.least[a : a + step] if at_least is None else np.maximum(best.least[a : a + step], at_least)
                    if len(v) > k:
                        cut = np.maximum(cut, np.partition(near, len(v) - k, axis=0)[len(v) - k])
                    i, j = np.nonzero(near >= cut)
                    best.add(a + j, at[i], near[i, j])
            if k:
                yield pd.DataFrame({"query_id": own[best.query], "vec_id": best.vector, "score": best.score})

        found = vectors.select("vec_id", "embedding").mapInPandas(scan, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if not k:
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fit_centroids(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on a bounded sample (the ``sample`` rows with the smallest hash of their id)."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lists = max(1, min(lists, len(x)))
    centres = x[np.random.default_rng(3).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def fit_probes(vectors: DataFrame, centres: np.ndarray, k: int = 10, recall: float = 0.95, sample: int = 20_000, queries: int = 200) -> int:
    """The fewest lists to probe so that the k nearest are found at the recall, measured by exact search within a bounded
    sample (the ``sample`` rows with the smallest hash of their id, of which the first ``queries`` ask)."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1)
    if len(x) <= k:
        return len(centres)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    asked = x[:queries]
    nearest = np.argpartition(-(asked @ x.T), k, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # rank of each list for each query
    own = (x @ centres.T).argmax(1)
    ranks = np.take_along_axis(order, own[nearest], 1)
    return next((p for p in range(1, len(centres)) if (ranks < p).mean() >= recall), len(centres))


def with_lists(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Each row once for each of its ``probes`` nearest centroids, as column ``list``."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def nearest(embedding: pd.Series) -> pd.Series:
        v = np.stack(embedding.to_numpy()).astype(np.float64)
        near = v @ shared.value.T
        return pd.Series(list(np.argsort(-near, axis=1)[:, :probes].astype(np.int32)))

    return vectors.withColumn("list", F.explode(F.pandas_udf(nearest, "array<int>")("embedding")))


#: Vectors of a list that a task holds at a time, and queries that it meets them with.
HELD, ASKING = 8192, 4096


def search_index(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 8) -> DataFrame:
    """Approximate search: index is with_lists() of every vector, kept or written by list; a query meets the vectors of its
    ``probes`` nearest lists only. Lists are cut in parts of bounded size; a part is multiplied with the queries that probe its
    list, a bounded number of them at a time, and sends on k rows for each."""
    asked = with_lists(queries.select("query_id", F.col("embedding").alias("embedding")), centres, probes)
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / HELD).cast("int").alias("parts"))
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("chunks"))
    cut = F.broadcast(sizes.join(chunks, "list"))  # a row a list
    part, chunk = (F.pmod(F.xxhash64(i), F.col(n)).cast("int").alias(n[:-1]) for i, n in (("vec_id", "parts"), ("query_id", "chunks")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    held = index.join(cut, "list").select("list", "vec_id", "embedding", part, each("chunks"))
    asking = asked.join(cut, "list").select("list", "query_id", "embedding", chunk, each("parts"))

    def unit_rows(embeddings: pd.Series) -> np.ndarray:
        v = np.stack(embeddings.to_numpy()).astype(np.float64)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(length == 0, 1, length)

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v = v.sort_values("vec_id", kind="stable")
        own, at, x, y = q.query_id.to_numpy(), v.vec_id.to_numpy(), unit_rows(q.embedding), unit_rows(v.embedding)
        best = _Nearest(len(own), k)
        for a in range(0, len(own), step := max(1, SCORES // len(at))):
            near = x[a : a + step] @ y.T
            least = np.partition(near, len(at) - k, axis=1)[:, len(at) - k, None] if len(at) > k else -np.inf
            i, j = np.nonzero(near >= least)
            best.add(a + i, at[j], near[i, j])
        return pd.DataFrame({"query_id": own[best.query], "vec_id": best.vector, "score": best.score})

    keys = ["list", "part", "chunk"]
    scored = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cache_key(namespace: Column, question: Column) -> Column:
    return F.left(F.md5(F.concat(namespace, question)), F.lit(16))


def cache_lookup(cache: DataFrame, query: list[float], namespace: str, now: Column, at_least: float = 0.88) -> DataFrame:
    """The nearest unexpired entry of a namespace if it is near enough and has an answer."""
    best = top_k(cache, query, 1, where=(F.col("namespace") == namespace) & (F.col("expires_at") > now), id_column="key")
    return best.where((F.col("score") >= at_least) & (F.coalesce("answer", F.lit("")) != ""))


def cache_entry(rows: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """rows(namespace, question, answer, embedding) as cache rows; answers are cut at 8000 characters."""
    return rows.select(cache_key(F.col("namespace"), F.col("question")).alias("key"), "namespace", "question", F.left("answer", F.lit(8000)).alias("answer"), "embedding", (now + ttl).alias("expires_at"))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """chunks(id, chunk_id, content, type, chunk_type, s3_uri, key_phrases, embedding) as rows for a vector store: an id from
    what there is, null and empty vectors left out, texts cut at 10,000 characters, ten key phrases at most."""
    some = lambda c: F.nullif(c, F.lit(""))
    ident = F.coalesce(some(F.col("id")), some(F.col("chunk_id")), F.concat(F.lit("chunk_"), F.left(F.md5("content"), F.lit(16))))
    return chunks.where(F.size("embedding") > 0).select(
        ident.alias("id"), F.left("content", F.lit(10_000)).alias("text"), F.coalesce(some(F.col("type")), some(F.col("chunk_type")), F.lit("text")).alias("type"),
        F.col("s3_uri"), F.array_join(F.slice(F.coalesce("key_phrases", F.array().cast("array<string>")), 1, 10), ", ").alias("key_phrases"), "embedding",
    )


def compact_metadata(text: Column, limit: int) -> Column:
    """The longest of the steps of a text (whole, 3/4, 1/2, 1/4, 1000, 500, 0 characters) whose JSON form keeps the limit."""
    steps = [text, *[F.left(text, F.floor(F.length(text) * s).cast("int")) for s in (0.75, 0.5, 0.25)], F.left(text, F.lit(1000)), F.left(text, F.lit(500))]
    fits = [F.when(F.octet_length(F.to_json(F.struct(s.alias("text")))) <= limit, s) for s in steps]
    return F.coalesce(*fits, F.lit(""))


def context_text(hits: DataFrame) -> DataFrame:
    """One row: hits(kind, name, text, score) grouped under their kinds, best first, scores to three digits."""
    line = F.concat(F.lit("- "), "name", F.lit(" (score:"), F.format_string("%.3f", "score"), F.lit("): "), "text")
    groups = hits.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", line.alias("line")))).alias("g"))
    block = F.concat(F.lit("## "), "kind", F.lit("\n"), F.array_join(F.transform("g", lambda s: s["line"]), "\n"))
    return groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def context_details(hits: DataFrame) -> DataFrame:
    """hits(score, table_name, entity_type, column_name, text): what the retrieved rows say, a row each: kind (table, column or
    relationship), table_name, name, description (cut as the kind asks), join_condition, score to three digits. Of a table's
    descriptions the best one counts."""
    table, kind = F.coalesce("table_name", F.lit("unknown")), F.coalesce("entity_type", F.lit("unknown"))
    cut = lambda n: F.when(F.length("text") > n, F.concat(F.left("text", F.lit(n)), F.lit("..."))).otherwise(F.col("text"))
    join = F.trim(F.regexp_extract("text", r"JOIN_CONDITION:([^\n]*)\n", 1))
    named = hits.withColumns({"table_name": table, "kind": kind})
    rows = named.where("kind = 'relationship' or kind = 'table' or kind = 'column' and column_name <> ''").select(
        "kind", "table_name", F.when(kind == "column", F.col("column_name")).otherwise("").alias("name"), F.when(kind == "relationship", cut(300)).otherwise(cut(200)).alias("description"),
        F.when(kind == "relationship", join).otherwise("").alias("join_condition"), F.round("score", 3).alias("score"),
        F.row_number().over(Window.partitionBy("kind", "table_name").orderBy(F.desc("score"), "text")).alias("n"),
    )
    return rows.where("kind <> 'table' or n = 1").drop("n")
