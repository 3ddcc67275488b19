import heapq
import random
import zlib

from sparkloom.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, size int"


def test_levels_equal_the_heap():
    r = random.Random(2)
    for _ in range(60):
        loads, size, count = [float(r.randint(0, 5000)) for _ in range(r.randint(1, 24))], float(r.randint(1, 400)), r.randint(1, 3000)
        heap, got = [(load, j) for j, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, j = heap[0]
            heapq.heapreplace(heap, (load + size, j))
            got[j] += 1
        assert S.deal_equal(loads, size, count) == got


def test_shards(spark):
    r = random.Random(4)
    rows = [(i, "é" * r.choice([0, 1, 5, 60, 60, 60, 900, 9000])) if i % 4 else (i, f"text {i} " * r.randint(1, 400)) for i in range(700)]
    rows += [(None, None), (None, ""), (5, rows[8][1]), (5, rows[8][1]), (9000, "z" * 100_000)]
    got = S.assign_shards(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), 24).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((g.doc_id, g.size, g.text_crc32) for g in got), key=str) == want
    by, loads, homes = {}, [0] * 24, {}
    for g in got:
        by.setdefault(g.shard, []).append(g.slot)
        loads[g.shard] += g.size
        homes.setdefault((g.text_crc32, g.size), set()).add(g.shard)
    assert set(by) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in homes.values())
    # as a heap over the groups themselves
    totals = {}
    for d, t in rows:
        totals[t or ""] = totals.get(t or "", 0) + len((t or "").encode()) + 8
    heap = [0] * 24
    for x in sorted(totals.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + x)
    assert sorted(loads) == sorted(heap)


def test_empty(spark):
    assert S.assign_shards(spark.createDataFrame([], SCHEMA)).collect() == []
