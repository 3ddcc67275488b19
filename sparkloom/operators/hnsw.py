"""A hierarchical navigable small-world index over vectors, kept as a table of neighbour lists.

Vectors are dealt into shards by the hash of their id; each shard is a graph of its own, so shards are built, kept and
searched side by side, and a query's best of all shards are merged. A vector is in the layers 0 to ``level``, which falls off
geometrically; in each layer it is linked to ``m`` of the ``ef_construction`` nearest of those that were there before it
(2 * m on the lowest), chosen so that they lie in different directions. What was there before a block of vectors is
compared with the block by one matrix product, so no link depends on a search's luck.

The index is a table (shard, layer, node, neighbours, embedding): the embedding is there on the lowest layer only. Any
other row order or partitioning of it gives the same answers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.search import check_dimensions

#: Vectors of a shard; queries that meet a shard in one task; similarities that are held at a time.
SHARD, ASKED, HELD = 20_000, 2_000, 4_000_000
INDEX = "shard int, layer int, node long, neighbours array<long>, embedding array<float>"
INDEX_SCHEMA = pa.schema([("shard", pa.int32()), ("layer", pa.int32()), ("node", pa.int64()), ("neighbours", pa.list_(pa.int64())), ("embedding", pa.list_(pa.float32()))])


def units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size == 0, 1, size)).astype(np.float32)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of vectors; short and missing ones are filled with zeros."""
    out = np.zeros((len(column), width), np.float32)
    for i, row in enumerate(column.to_pylist()):
        row = (row or [])[:width]
        out[i, : len(row)] = [x or 0.0 for x in row]
    return out


def spread_out(near: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to the node than to any that was chosen; then the nearest others."""
    between = x[near] @ x[near].T
    chosen, rest = [], []
    for i in range(len(near)):
        if len(chosen) == most:
            break
        (chosen if not chosen or sims[i] > between[i, chosen].max() else rest).append(i)
    return near[chosen + rest[: most - len(chosen)]].tolist()


def levels(ids: np.ndarray, m: int) -> np.ndarray:
    """The highest layer of each vector, drawn from its id."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    drawn = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(drawn, 1e-18)) / math.log(m)).astype(int)


def linked_layer(x: np.ndarray, most: int, m: int, ef: int) -> list[list[int]]:
    """Neighbours of the rows of a layer in the order of their coming: ``most`` at most, ``m`` chosen when they come."""
    links: list[list[int]] = [[] for _ in range(len(x))]
    step = max(1, HELD // max(1, len(x)))
    for a in range(1, len(x), step):
        b = min(a + step, len(x))
        sims = x[a:b] @ x[:b].T
        for i in range(a, b):
            own = sims[i - a, :i]
            near = np.argpartition(-own, ef)[:ef] if i > ef else np.arange(i)
            near = near[np.argsort(-own[near], kind="stable")]
            links[i] = spread_out(near, own[near], x, m)
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > most:
                    others = np.array(links[j])
                    to = x[others] @ x[j]
                    order = np.argsort(-to, kind="stable")
                    links[j] = spread_out(others[order], to[order], x, most)
    return links


def built_shard(ids: np.ndarray, vectors: np.ndarray, m: int, ef: int) -> list[tuple[int, int, list[int]]]:
    """(layer, place, neighbours' places) of a shard whose vectors come in this order."""
    x, level = units(vectors), levels(ids, m)
    rows = []
    for layer in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= layer)
        for i, near in enumerate(linked_layer(x[own], 2 * m if layer == 0 else m, m, ef)):
            rows.append((layer, int(own[i]), own[near].tolist()))
    return rows


def build(vectors: DataFrame, m: int = 16, ef_construction: int = 64, shard: int = SHARD) -> DataFrame:
    """vectors(vec_id, embedding): the index table. Null ids and null vectors are left out; of rows with the same id one stays."""
    width = max(1, check_dimensions(vectors))
    rows = vectors.where("vec_id is not null and embedding is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    shards = max(1, -(-rows.count() // shard))

    def make(table: pa.Table) -> pa.Table:
        own = table.column("shard")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        order = np.lexsort((ids, -levels(ids, m)))  # those of high layers come first, so entries are there from the start
        ids, x = ids[order], matrix(table.column("embedding"), width)[order]
        out = [(own, layer, int(ids[i]), ids[near].tolist(), x[i].tolist() if layer == 0 else None) for layer, i, near in built_shard(ids, x, m, ef_construction)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), INDEX_SCHEMA, strict=True)], schema=INDEX_SCHEMA)

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
    return dealt.groupBy("shard").applyInArrow(make, INDEX)


class Graph:
    """One shard's layers, for searching."""

    def __init__(self, index: pa.Table, width: int):
        layer = index.column("layer").to_numpy()
        base = index.filter(pa.array(layer == 0))
        self.ids = base.column("node").to_numpy()
        self.x = units(matrix(base.column("embedding"), width))
        place = {n: i for i, n in enumerate(self.ids.tolist())}
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(layer.max(initial=0)) + 1)]
        for k, node, near in zip(layer.tolist(), index.column("node").to_pylist(), index.column("neighbours").to_pylist(), strict=True):
            self.layers[k][place[node]] = [place[n] for n in near]
        self.entry = min(self.layers[-1], key=lambda i: self.ids[i])

    def beam(self, q: np.ndarray, start: int, links: dict[int, list[int]], ef: int) -> list[tuple[float, int]]:
        """The ef nearest that a walk from start meets: (similarity, place)."""
        first = float(self.x[start] @ q)
        seen, todo, best = {start}, [(-first, start)], [(first, start)]
        while todo:
            far, at = heapq.heappop(todo)
            if len(best) == ef and -far < best[0][0]:
                break
            new = [n for n in links[at] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for s, n in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < ef or s > best[0][0]:
                    heapq.heappush(todo, (-s, n))
                    heapq.heappush(best, (s, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return best

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
        at = self.entry
        for links in self.layers[:0:-1]:
            at = max(self.beam(q, at, links, 1))[1]
        found = sorted(self.beam(q, at, self.layers[0], max(ef, k)), key=lambda p: (-p[0], self.ids[p[1]]))
        return [(int(self.ids[i]), s) for s, i in found[:k]]


def search(queries: DataFrame, index: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
    """queries(query_id, embedding): query_id, vec_id, score (cosine), rank of the k nearest that the walks through each shard
    find. A task holds one shard and at most some ASKED queries."""
    width = max(1, check_dimensions(queries))
    shards = [r[0] for r in index.select("shard").distinct().collect()]
    parts = max(1, -(-queries.count() // ASKED))
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.select(F.explode(F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"))

    def walk(own: pa.Table, others: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if len(own) and len(others):
            graph = Graph(own, width)
            for query, q in zip(others.column("query_id").to_pylist(), units(matrix(others.column("asked"), width)), strict=True):
                rows += [(query, n, s) for n, s in graph.search(q, k, ef)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), found, strict=True)], schema=found)

    met = held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(walk, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def inserted(index: DataFrame, vectors: DataFrame, m: int = 16, ef_construction: int = 64, shard: int = SHARD) -> DataFrame:
    """The index with more vectors: they make shards of their own, numbered on; a new vector of a known id takes its place."""
    last = index.agg(F.max("shard")).first()[0]
    more = build(vectors, m, ef_construction, shard)
    gone = vectors.select(F.col("vec_id").cast("long").alias("node")).distinct()
    stale = index.join(gone, "node", "left_semi").select("shard").distinct()
    touched = index.join(stale, "shard", "left_semi").where("layer = 0").select(F.col("node").alias("vec_id"), "embedding").join(gone.withColumnRenamed("node", "vec_id"), "vec_id", "left_anti")
    kept = index.join(stale, "shard", "left_anti")
    rebuilt = build(touched, m, ef_construction, shard)  # a graph can't lose a node: its shard is built again without it
    base = 0 if last is None else last + 1
    moved = rebuilt.withColumn("shard", F.col("shard") + base)
    beyond = max(1, -(-touched.count() // shard))
    return kept.unionByName(moved).unionByName(more.withColumn("shard", F.col("shard") + base + beyond))
