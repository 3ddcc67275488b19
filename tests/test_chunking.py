import random

from sparkloom.operators import chunking as C


def item(n, kind="paragraph", size=100, crumb="A > x", **attributes):
    return {"id": f"i{n}", "type": kind, "content": "w" * size, "metadata": {"breadcrumbs": crumb, **attributes}}


def fold(items, **sizes):
    return C.fold_boundaries(items, C.Sizes(**({"target": 300, "least": 150, "most": 500, "table": 200} | sizes)))


def test_groups_flush_at_the_target_but_not_before_a_header():
    got = fold([item(0), item(1), item(2), item(3, "header"), item(4)])
    assert [g["ids"] for g in got] == [["i0", "i1", "i2", "i3", "i4"]] or [len(g["ids"]) for g in got] == [4, 1]
    assert got[0]["char_count"] == len(got[0]["content"])


def test_images_and_large_tables_stand_alone():
    got = fold([item(0), item(1, "image", 20), item(2, "table", 250), item(3, "table", 250, is_large="no"), item(4, "table", 20, is_large="yes")])
    assert [(g["ids"], g["type"]) for g in got] == [(["i0"], None), (["i1"], "image_offloaded"), (["i2"], "table_offloaded"), (["i3"], None), (["i4"], "table_offloaded")]


def test_root_change_flushes_small_groups_and_short_items_are_skipped():
    got = fold([item(0, size=20), item(1, size=5), item(2, size=20, crumb="B"), item(3, size=20, crumb="B > y")])
    assert [g["ids"] for g in got] == [["i0"], ["i2", "i3"]] and [g["breadcrumbs"] for g in got] == ["A > x", "B > y"]


def test_small_tail_joins_the_chunk_before_it():
    got = fold([item(0, size=300), item(1, size=50)])
    assert [g["ids"] for g in got] == [["i0", "i1"]]
    assert [g["ids"] for g in fold([item(0, size=480), item(1, size=50)])] == [["i0"], ["i1"]]


def test_nothing_is_lost():
    r = random.Random(1)
    for _ in range(200):
        items = [item(n, r.choice(["paragraph", "header", "table", "image"]), r.randint(0, 400), r.choice(["A > x", "A", "B", ""])) for n in range(r.randint(0, 40))]
        ids = [i for g in fold(items) for i in g["ids"]]
        assert ids == [i["id"] for i in items if len(i["content"]) >= 10]


def test_marked_pages(spark):
    page = '<!-- BOUNDARY_START type="text" id="p1_text_1" page="1" breadcrumbs="A &gt; B" -->\r\nSome text that counts\r\n<!-- BOUNDARY_END type="text" id="p1_text_1" -->\n<!-- BOUNDARY_START id="x" -->\n  y  \n<!-- BOUNDARY_END id="x" -->'
    got = C.atomic_chunks(spark.createDataFrame([(1, 1, page)], "doc_id long, page int, text string")).orderBy("seq").collect()
    assert [(g.seq, g.id, g.type, g.page, g.content, g.metadata) for g in got] == [(1, "p1_text_1", "text", "1", "Some text that counts", {"breadcrumbs": "A > B"}), (2, "x", "unknown", "0", "y", {})]


PAGE = """# Page 1
# Title
Intro line.
## Part
- one
12.5% of all
text
```
# not a header
```

| a | b |
|---|---|
| 1 | 2 |
### Deep
<!-- note -->
**Image 1:** a chart
end of it
"""


def test_sections():
    got = C.parse_sections(PAGE)
    assert [s["type"] for s in got] == ["major_header", "text", "major_header", "text", "text", "code", "table", "minor_header", "image"]
    assert got[3]["content"] == "- one\n12.5% of all\n" and got[7]["breadcrumbs"] == ["Title", "Part", "Deep"]
    assert all(PAGE[s["start"] : s["end"]].strip("\n") >= "" for s in got)


def test_blocks_merge_where_they_overlap():
    text = "**Image 1:** ```x``` y\n# H"
    assert C.protected_blocks(text) == [(0, text.index("\n"), "image")]


def test_split_and_dedup():
    sizes = C.Sizes(40, 20, 60)
    text = " ".join(f"Sentence number {i} is here." for i in range(12))
    pieces = C.smart_split(text, sizes)
    assert " ".join(pieces) == text and all(len(p) >= 20 for p in pieces[:-1])
    chunks = C.section_chunks("```x```\n```x```\n```y```\n", sizes)
    assert [c["content_only"] for c in chunks] == ["```x```", "```y```"] and chunks[0]["text"].startswith("Context: \n\n")


def test_continuation_and_merge(spark):
    pages = spark.createDataFrame([(1, 1, "A text that ends with data and"), (1, 2, "goes on here."), (1, 3, "1. next"), (2, 1, "Done."), (2, 2, "Other.")], "doc_id long, page int, text string")
    signals = C.continuation_signals(pages)
    got = {(s.doc_id, s.page): s.signals for s in signals.collect()}
    assert got == {(1, 1): ["conjunction", "no_punctuation"], (1, 2): ["numbered_list"], (2, 1): []}
    merged = C.merged_pages(C.semantic_chunks(pages), signals).orderBy("doc_id", "page").collect()
    assert [(m.doc_id, m.page, m.merged_from_pages) for m in merged] == [(1, 1, [1, 2]), (1, 3, None), (2, 1, None), (2, 2, None)]
    assert merged[0].content_only == "A text that ends with data and\n\ngoes on here."


def test_statistics(spark):
    rows = [("x" * n, "text", 1) for n in (1, 2, 3, 4)]
    s = C.chunk_statistics(spark.createDataFrame(rows, "content_only string, type string, page int")).first()
    assert (s.median, s.p25, s.p75, s.mean, s.std) == (3, 2, 4, 2.5, 1.1)


def test_repeated_attribute(spark):
    text = '<!-- BOUNDARY_START type="a" id="1" type="paragraph" page="2" x="1" x="2" -->\nsome words\n<!-- BOUNDARY_END type="paragraph" id="1" -->'
    rows = C.atomic_chunks(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")).collect()
    assert [(r.type, r.id, r.metadata) for r in rows] == [("paragraph", "1", {"x": "2"})]
