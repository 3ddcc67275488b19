"""Shards of nearly equal size by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, to the shard with the least load, through a heap. Groups
of equal size can stand for each other, so the heap runs over a histogram of sizes, not over groups: the driver gets a
row for each size class. Sizes below 8192 are classes of their own, larger ones share a class with what agrees in their
13 leading bits, so there are at most 4096 classes for each power of two, however many groups there are. All the rest
(ranks within a class, slots within a shard) is counted in cells and summed up by windows over cells, in SQL.

Defined results: a null text counts as an empty one and has size 8; rows with a null doc_id are sharded like any other;
repeated rows stay together and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, text_or_empty

#: Row overhead that counts as size, and cells that a class or shard is counted in.
OVERHEAD, CELLS = 8, 256
#: From this count on, a class is dealt by levels and not item by item.
MANY = 512


def deal_equal(loads: list[float], size: float, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets when each item goes to the least-loaded shard (the first
    of equals): the same as ``count`` steps of the heap."""
    shards = len(loads)
    if count < MANY:
        heap = [(load, j) for j, load in enumerate(loads)]
        heapq.heapify(heap)
        got = [0] * shards
        for _ in range(count):
            load, j = heap[0]
            heapq.heapreplace(heap, (load + size, j))
            got[j] += 1
        return got
    base = np.array(loads, np.float64)
    low, high = base.min(), base.max() + size * (count + 1)
    below = lambda level: np.maximum(0, np.ceil((level - base) / size))  # noqa: E731  items that start under the level
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if below(mid).sum() <= count else (low, mid)
    got = below(low).astype(np.int64)
    heap = [(base[j] + size * int(got[j]), j) for j in range(shards)]
    heapq.heapify(heap)
    for _ in range(count - int(got.sum())):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
        got[j] += 1
    return got.tolist()


def schedule(histogram: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """histogram: (class, groups, bytes). For each class, up to which rank (from 1) its groups go to shards 0, 1, ..."""
    loads, plan = [0.0] * shards, []
    for cls, count, size in sorted(histogram, reverse=True):
        each = size / count
        got = deal_equal(loads, each, count)
        loads = [load + each * n for load, n in zip(loads, got, strict=True)]
        plan.append((cls, np.cumsum(got).tolist()))
    return plan


def assign_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """documents(doc_id, text). Returns doc_id, size, text_crc32, shard and slot (from 0, without gaps, in each shard)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "shards")
    text = text_or_empty()
    rows = scratch.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        ),
        "rows",
    )
    bits = F.expr("greatest(0, cast(floor(log2(total)) as int) - 12)")
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"))
    groups = groups.withColumn("drop", bits).select(
        "group", "total", F.expr("shiftleft(shiftright(total, drop), drop)").alias("class"), F.pmod(F.xxhash64("group"), F.lit(CELLS)).alias("cell")
    )
    cells = scratch.table(groups.groupBy("class", "cell").agg(F.count("*").alias("n"), F.sum("total").alias("bytes")), "cells")
    histogram = [tuple(r) for r in cells.groupBy("class").agg(F.sum("n"), F.sum("bytes")).collect()]
    plan = spark.createDataFrame(schedule(histogram, shards), "class long, upto array<long>")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("class", "cell", F.coalesce(before, F.lit(0)).alias("offset")).join(plan, "class")
    rank = F.row_number().over(Window.partitionBy("class", "cell").orderBy("group")) + F.col("offset")
    placed = groups.join(offsets, ["class", "cell"]).select("group", "upto", rank.alias("rank"))
    placed = placed.select("group", F.size(F.filter("upto", lambda u: u < F.col("rank"))).alias("shard"))
    put = scratch.table(rows.join(placed, "group").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "group"), F.lit(CELLS)).alias("cell")), "put")
    counts = put.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1 + F.col("start")
    return put.join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
