"""Connected components of an edge table, without ever gathering links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch

#: Links that a task thins out at a time.
THINNED = 250_000
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of a partition, those that connect what the ones before them don't: stars around the smallest node of
    each group, a bounded number of links at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs, strict=True) if pairs else ([], []))], schema=PAIR)

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
        if len(root) > THINNED:
            yield stars()
            root.clear()
    yield stars()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges(a, b): long ids. Returns node, root for every node with an edge; root is the smallest node reachable.

    Alternates the two star operations (large star: larger neighbours are hung on the smallest neighbour; small star:
    the node and its smaller neighbours are) until nothing changes; each halves the depth of chains at least. The
    smallest neighbour is a plain minimum, so a hub of a million links is summed before it is shuffled. Each round is
    a written table. Before the first one, tasks thin out the links that they hold."""

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = scratch.table(oriented(edges), "edges")
    thin = now.coalesce(max(1, now.count() // THINNED)).mapInArrow(forests, "a long, b long")
    now = scratch.table(oriented(thin), "thinned")
    seen = print_of(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        stars = scratch.table(large, "large")
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        after = scratch.table(small.select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "small")
        print_after = print_of(after)
        if print_after == seen:
            now = after
            break
        now, seen = after, print_after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
