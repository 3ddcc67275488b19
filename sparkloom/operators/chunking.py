"""Structure-aware chunking: boundary-marked pages, markdown sections, sentence splits, and page continuation.

What is sequential inside a document (flushes that depend on what was kept) is a fold over its ordered pieces, one group a
document; all else is column expressions. Documents are independent, so nothing crosses groups."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

BOUNDARY = r"(?s)<!-- BOUNDARY_START (.*?) -->\n(.*?)\n<!-- BOUNDARY_END (.*?) -->"
OFFLOADED = ("picture", "image", "figure")


@dataclass(frozen=True)
class Sizes:
    target: int = 1500
    least: int = 800
    most: int = 3000
    table: int = 2000

    def __post_init__(self):
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("sizes must be positive and in order: least, target, most")


def atomic_chunks(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text): the marked pieces in order: doc_id, seq, id, type, page, content, metadata."""
    clean = F.regexp_replace("text", r"\r\n?", "\n")
    marked = pages.select("doc_id", "page", F.posexplode(F.regexp_extract_all(clean, F.lit(BOUNDARY), F.lit(0))).alias("n", "raw"))
    head, body = F.regexp_extract("raw", BOUNDARY, 1), F.regexp_extract("raw", BOUNDARY, 2)
    attribute = r'(\w+)="([^"]*)"'
    pairs = F.transform(F.regexp_extract_all(head, F.lit(attribute), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, attribute, 1).alias("k"), T.html_unescape(F.regexp_extract(a, attribute, 2)).alias("v")))
    # the last value of a repeated attribute counts
    repeated = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~repeated(p, i)))
    with_map = marked.select("doc_id", F.col("page").alias("file_page"), "n", T.trim_all(body).alias("content"), last.alias("m"))
    known = lambda k, d: F.coalesce(F.col("m")[k], F.lit(d))
    rest = F.map_filter("m", lambda k, v: ~k.isin("type", "id", "page"))
    order = Window.partitionBy("doc_id").orderBy("file_page", "n")
    return with_map.select(
        "doc_id", F.row_number().over(order).alias("seq"), known("id", "unknown").alias("id"), known("type", "unknown").alias("type"), known("page", "0").alias("page"), "content", rest.alias("metadata")
    )


def _root(path: str | None) -> str:
    path = path or ""
    for sep in (" > ", " / ", " | ", " :: "):
        if sep in path:
            return path.split(sep)[0].strip()
    return path.strip()


class _Group:
    """Chunks gathered for one output chunk."""

    def __init__(self):
        self.items, self.size = [], 0

    def add(self, item, size):
        self.items.append(item)
        self.size += size


def fold_boundaries(items: list[dict], sizes: Sizes) -> list[dict]:
    """items: id, type, content, metadata, in order. Large tables and images stand alone; the rest is grouped by size and by
    the root of the breadcrumbs, and a small last group joins the one before it where it fits."""
    out: list[dict] = []
    group, crumb = _Group(), None

    def emit(chosen, kind=None):
        texts = [i["content"].strip() for i in chosen if i["content"].strip()]
        if texts:
            body = "\n\n".join(texts)
            uri = next((i["metadata"].get("s3_uri") for i in chosen if i["metadata"].get("s3_uri")), None)
            out.append({"content": body, "ids": [i["id"] for i in chosen], "breadcrumbs": crumb, "char_count": len(body), "num_atomic_chunks": len(chosen), "chunk_types": [i["type"] for i in chosen], "type": kind, "s3_uri": uri})

    for n, item in enumerate(items):
        size = len(item["content"].strip())
        here = item["metadata"].get("breadcrumbs", "")
        if size < 10:
            continue
        mark = item["metadata"].get("is_large", "")
        big_table = item["type"] == "table" and (mark == "yes" or (not mark and size > sizes.table))
        if item["type"] in OFFLOADED or big_table:
            emit(group.items)
            group, crumb = _Group(), here
            emit([item], "table_offloaded" if big_table else "image_offloaded")
            continue
        if group.items and crumb and here and _root(crumb) != _root(here):
            emit(group.items)
            group = _Group()
        if group.size + size > sizes.most and group.size >= sizes.least:
            emit(group.items)
            group = _Group()
        group.add(item, size)
        crumb = here
        header_next = n + 1 < len(items) and items[n + 1]["type"] == "header"
        if group.size >= sizes.target and not header_next:
            emit(group.items)
            group = _Group()
    if group.items:
        last = out[-1] if out else None
        fits = last is not None and last["type"] is None and last["char_count"] + group.size <= sizes.most
        if group.size < sizes.least and fits and _root(last["breadcrumbs"]) == _root(crumb):
            texts = [last["content"], *(i["content"].strip() for i in group.items)]
            last["content"] = "\n\n".join(texts)
            last["char_count"] = len(last["content"])
            last["ids"] += [i["id"] for i in group.items]
            last["chunk_types"] += [i["type"] for i in group.items]
            last["num_atomic_chunks"] += len(group.items)
        else:
            emit(group.items)
    return out


CHUNK_SCHEMA = "doc_id long, chunk_no int, content string, breadcrumbs string, char_count int, num_atomic_chunks int, chunk_types array<string>, type string, s3_uri string, ids array<string>"
CHUNK_ARROW = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("content", pa.string()), ("breadcrumbs", pa.string()), ("char_count", pa.int32()), ("num_atomic_chunks", pa.int32()), ("chunk_types", pa.list_(pa.string())), ("type", pa.string()), ("s3_uri", pa.string()), ("ids", pa.list_(pa.string()))])


def boundary_chunks(atoms: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """atoms as of atomic_chunks: the grouped chunks of each document."""
    sizes = sizes or Sizes()

    def folded(doc_id, items: list[dict]) -> list[dict]:
        return [{"doc_id": doc_id, "chunk_no": i, **f} for i, f in enumerate(fold_boundaries(items, sizes))]

    def fold(batches):
        """The rows of a document come one after another: it is folded when the next one begins."""
        own, items = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if items and r["doc_id"] != own:
                    out += folded(own, items)
                    items = []
                own = r["doc_id"]
                items.append({"id": r["id"], "type": r["type"], "content": r["content"] or "", "metadata": dict(r["metadata"] or [])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=CHUNK_ARROW)
        if items and (out := folded(own, items)):
            yield pa.RecordBatch.from_pylist(out, schema=CHUNK_ARROW)

    rows = atoms.select("doc_id", "seq", "id", "type", "content", "metadata").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return rows.mapInArrow(fold, CHUNK_SCHEMA)


# Blocks that are never cut, as patterns of the marks around them.
IMAGE_BLOCKS = (
    r">\$\$\$\$\$.*?\$\$\$\$\$",
    r">\$\$\$\$\$\s*\n\s*\*\*Visual Element\*\*.*?\$\$\$\$\$",
    r">\$\$\$\$\$\s*\n\s*\*\*Table/Chart\*\*.*?\$\$\$\$\$",
    r"\*\*Images? on this page:?\*\*.*?(?=\n#{1,3}\s|\n---|\Z)",
    r"\*\*Image \d+:?\*\*.*?(?:\*AI Description:\*.*?)?(?=\n\*\*Image|\n#{1,3}\s|\n---|\Z)",
    r"\*\*Visual Content.*?\*\*.*?(?=\n#{1,3}\s|\n---|\Z)",
    r"\*\*Complete Page Visual Analysis.*?\*\*.*?(?=\n#{1,3}\s|\n---|\Z)",
    r"> \*\*Figure \d+.*?(?=\n\n(?!>)|\Z)",
)
TABLE_BLOCK = (
    r"\n(\|[^\n]+\|\n)(\|[-:\s|]+\|\n)((?:\|[^\n]+\|\n)+)(?:\n\*\*Table.*?(?=\n\n|\n#{1,3}\s|\Z))?"
    r"(?:\n\*\*Table \d+ Summary:?\*\*.*?(?=\n\n|\n#{1,3}\s|\n\*\*Table|\n\*\*Image|\Z))?"
)
CODE_BLOCK = r"```.*?```"
BLOCKS = [(k, re.compile(p, re.S | re.I)) for k, ps in (("image", IMAGE_BLOCKS), ("table", (TABLE_BLOCK,)), ("code", (CODE_BLOCK,))) for p in ps]
HEADER, LIST_ITEM = re.compile(r"^(#{1,6})\s+(.+)"), re.compile(r"^[-*+]|\d+\.")
GAP = re.compile(r"(?<=[.!?])\s+")


def protected_blocks(text: str) -> list[tuple[int, int, str]]:
    """Spans that are never cut: by start, the longest of equals first; what overlaps is joined under the first one's kind."""
    spans = sorted({(m.start(), m.end(), kind) for kind, p in BLOCKS for m in p.finditer(text)}, key=lambda s: (s[0], -s[1], s[2]))
    out: list[tuple[int, int, str]] = []
    for s, e, kind in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, kind))
    return out


def parse_sections(text: str) -> list[dict]:
    """Blocks, headers, list runs and lines of a page, with the breadcrumbs above them. A block counts only where the scan
    meets its first character."""
    starts = {s: (e, kind) for s, e, kind in protected_blocks(text)}
    out: list[dict] = []
    crumbs: list[str] = []
    run: list[int] = []  # begin of a run of list lines, and its end so far

    def add(kind, content, start, end):
        out.append({"type": kind, "content": content, "breadcrumbs": list(crumbs), "start": start, "end": end})

    def close(at):
        if run:
            add("text", "".join(held), run[0], at)
            run.clear()
            held.clear()

    held: list[str] = []
    at = 0
    while at < len(text):
        if at in starts:
            close(at)
            end, kind = starts[at]
            add(kind, text[at:end], at, end)
            at = end
            continue
        end = text.find("\n", at)
        end = (len(text) if end < 0 else end) + 1
        line = text[at:end]
        bare = line.strip()
        header = HEADER.match(bare)
        if not bare or bare.startswith("<!--"):
            pass
        elif header:
            close(at)
            level, title = len(header[1]), header[2].strip()
            if not (level == 1 and title.startswith("Page ")):
                crumbs[level - 1 :] = [title]
                add("major_header" if level <= 2 else "minor_header", title, at, end)
        elif LIST_ITEM.match(bare):
            if not run:
                run.append(at)
            held.append(line)
        else:
            close(at)
            add("text", line, at, end)
        at = end
    close(at)
    return out


def smart_split(text: str, sizes: Sizes) -> list[str]:
    """Sentences packed up to the target; a piece closes only once it has the least size, and the last is kept as it is."""
    out, now, size = [], [], 0
    for sentence in GAP.split(text):
        if now and size + len(sentence) > sizes.target and size >= sizes.least:
            out.append(" ".join(now))
            now, size = [], 0
        now.append(sentence)
        size += len(sentence)
    return [*out, " ".join(now)] if now else out


def section_chunks(text: str, sizes: Sizes) -> list[dict]:
    """Chunks of a page from its sections: blocks alone; text under the breadcrumbs at the time of the flush. A chunk whose
    id is among the last five kept is dropped."""
    out: list[dict] = []
    held: list[str] = []
    crumbs: list[str] = []

    def keep(kind, content, path):
        content = content.strip() if kind == "text" else content
        if not content.strip():
            return
        where = " > ".join(path)
        full = f"Context: {where}\n\n{content}"
        ident = hashlib.md5(full.encode()).hexdigest()
        if ident not in [c["id"] for c in out[-5:]]:
            out.append({"id": ident, "text": full, "content_only": content, "type": kind, "breadcrumbs": list(path)})

    def flush():
        body = "".join(held).strip()
        held.clear()
        for piece in [body] if len(body) <= sizes.most else smart_split(body, sizes):
            keep("text", piece, crumbs)

    for s in parse_sections(text):
        if s["type"] in ("image", "table", "code"):
            flush()
            keep(s["type"], s["content"], s["breadcrumbs"])
        elif s["type"].endswith("_header"):
            if s["type"] == "major_header" and sum(map(len, held)) >= sizes.least:
                flush()
            crumbs = s["breadcrumbs"]
        else:
            held.append(s["content"])
            if sum(map(len, held)) >= sizes.target:
                flush()
    flush()
    return out


SECTION_SIZES = Sizes(1500, 800, 2500)
PAGE_CHUNKS = "doc_id long, page int, chunk_no int, id string, text string, content_only string, type string, breadcrumbs array<string>"


def semantic_chunks(pages: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """pages(doc_id, page, text): chunks of each page. A page is a unit of work, so no shuffle is needed."""
    sizes = sizes or SECTION_SIZES

    def scan(batches):
        for rows in batches:
            found = [{"doc_id": r.doc_id, "page": r.page, "chunk_no": i, **c} for r in rows.itertuples() for i, c in enumerate(section_chunks(r.text or "", sizes))]
            yield pd.DataFrame(found, columns=["doc_id", "page", "chunk_no", "id", "text", "content_only", "type", "breadcrumbs"])

    return pages.select("doc_id", "page", "text").mapInPandas(scan, PAGE_CHUNKS)


# Endings that say that a text goes on; "a" is an ending of any word.
GOES_ON = ("and", "or", "but", "the", "a", "an", "of", "to", "in", "with", "for", "on", "at", "by", "from")
ENDS = (".", "!", "?", ":", "---")


def continuation_signals(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text): for each page with a next one, the signals that it goes on there."""
    order = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.select("doc_id", "page", T.trim_all(F.right("text", F.lit(200))).alias("end"), F.lead("text").over(order).alias("next")).where("next is not null")
    begin, end = T.trim_all(F.left("next", F.lit(200))), F.col("end")
    low = F.lower(end)
    any_end = lambda c, words: F.greatest(*[c.endswith(w).cast("int") for w in words]) == 1
    signals = [
        F.when(any_end(low, GOES_ON), "conjunction"), F.when(~any_end(end, ENDS), "no_punctuation"), F.when(begin.rlike(r"^\d+\."), "numbered_list"), F.when(begin.rlike(r"^[-*+]"), "bullet_list"),
        F.when(end.rlike(r"\|.*\|$") & begin.rlike(r"^\|"), "table"), F.when(end.rlike(r"(^|\n)#{1,6}\s+[^\n]+$"), "header"),
    ]
    return rows.select("doc_id", "page", F.array_compact(F.array(*signals)).alias("signals"))


def merged_pages(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """Joins the last chunk of a page to the first of the next where the text goes on and both are text. Pages go in pairs: a
    page that was joined to the one before is not tested against the one after."""
    goes = signals.where("size(signals) > 0").select("doc_id", "page")
    # runs of pages that go on: within a run every other page begins a pair
    order = Window.partitionBy("doc_id").orderBy("page")
    runs = goes.withColumn("run", F.col("page") - F.row_number().over(order))
    pairs = runs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("page"))).where("n % 2 = 1").select("doc_id", "page")
    per_page = Window.partitionBy("doc_id", "page")
    edged = chunks.withColumn("is_last", F.col("chunk_no") == F.max("chunk_no").over(per_page))
    tail = edged.where("is_last and type = 'text'").join(pairs, ["doc_id", "page"]).select("doc_id", "page", F.col("content_only").alias("a"), F.col("breadcrumbs").alias("ca"), "chunk_no")
    head = chunks.where("chunk_no = 0 and type = 'text'").select("doc_id", (F.col("page") - 1).alias("page"), F.col("content_only").alias("b"), F.col("breadcrumbs").alias("cb"))
    joined = tail.join(head, ["doc_id", "page"])
    path = F.when(F.size("cb") > F.size("ca"), F.col("cb")).otherwise(F.col("ca"))
    body = F.concat("a", F.lit("\n\n"), "b")
    full = F.concat(F.lit("Context: "), F.array_join(path, " > "), F.lit("\n\n"), body)
    new = joined.select("doc_id", "page", "chunk_no", F.md5(full).alias("id"), full.alias("text"), body.alias("content_only"), F.lit("text").alias("type"), path.alias("breadcrumbs"), F.array("page", F.col("page") + 1).alias("merged_from_pages"))
    gone = joined.select("doc_id", "page", "chunk_no").unionByName(joined.select("doc_id", (F.col("page") + 1).alias("page"), F.lit(0).alias("chunk_no")))
    kept = chunks.join(gone.distinct(), ["doc_id", "page", "chunk_no"], "left_anti").withColumn("merged_from_pages", F.lit(None).cast("array<int>"))
    return kept.unionByName(new.select(*kept.columns))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row: count, sizes (mean and population deviation to one digit, upper median and quartiles) and counts by type."""
    sized = chunks.select(F.length("content_only").alias("x"), "type", "page")
    by_size = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = sized.groupBy("x").agg(F.count("*").alias("n"))  # lengths are few, chunks are many
    upto = counts.select("x", F.sum("n").over(by_size).alias("upto"))
    total = sized.agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 1).alias("mean"), F.round(F.stddev_pop("x"), 1).alias("std"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "image").alias("images"), F.count_if(F.col("type") == "code").alias("codes"))
    at = lambda e, name: F.min(F.when(F.col("upto") > F.expr(e), F.col("x"))).alias(name)
    quartiles = upto.join(F.broadcast(total.select("n")), F.lit(True)).agg(at("n div 2", "median"), at("n div 4", "p25"), at("(3 * n) div 4", "p75"))
    return total.join(quartiles, F.lit(True))


def of_type(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.where(F.col("type") == kind)


def of_page(chunks: DataFrame, page: int) -> DataFrame:
    """Pages are compared as numbers, however they are written."""
    return chunks.where(F.col("page").cast("int") == page)


def under_breadcrumb(chunks: DataFrame, part: str) -> DataFrame:
    """Chunks whose breadcrumbs have the part, in any case; chunks without any have the empty part only."""
    return chunks.where(F.contains(F.lower(F.coalesce(F.col("metadata")["breadcrumbs"], F.lit(""))), F.lower(F.lit(part))))


def text_only(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("type").isin("paragraph", "header"))


REQUIRED = ("id", "text", "content_only")
REQUIRED_METADATA = ("source", "page_number", "type", "breadcrumbs")


def judged_chunks(chunks: DataFrame, most: int = 3000) -> DataFrame:
    """chunks(id, text, content_only, metadata map) with what is wrong (the first of: a field, then a metadata key, is absent;
    no content), or null, and whether the content is over one and a half times the largest size, which is allowed."""
    field = F.lit(False)
    for c in REQUIRED:
        field = field | F.col(c).isNull()
    keys = F.map_keys("metadata")
    key = F.lit(False)
    for c in REQUIRED_METADATA:
        key = key | ~F.array_contains(keys, c)
    fault = F.when(field | F.col("metadata").isNull(), "field").when(key, "metadata").when(T.trim_all(F.col("content_only")) == "", "empty")
    return chunks.withColumns({"fault": fault, "oversize": fault.isNull() & (F.length("content_only") > most * 1.5)})


def hierarchical_context(breadcrumbs: Column) -> Column:
    """map: full_path, depth, and level_1 to level_n."""
    levels = F.map_from_arrays(F.transform(breadcrumbs, lambda b, i: F.format_string("level_%d", i + 1)), breadcrumbs)
    return F.map_concat(F.create_map(F.lit("full_path"), F.array_join(breadcrumbs, " > "), F.lit("depth"), F.size(breadcrumbs).cast("string")), levels)


def page_blocks(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text): the spans that are never cut, with whether each lies in its text and after the one before."""

    def scan(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                before = 0
                for start, end, kind in protected_blocks(r.text or ""):
                    out.append((r.doc_id, r.page, start, end, kind, before <= start < end <= len(r.text)))
                    before = end
            yield pd.DataFrame(out, columns=["doc_id", "page", "start", "end", "kind", "well_formed"])

    return pages.select("doc_id", "page", "text").mapInPandas(scan, "doc_id long, page int, start int, end int, kind string, well_formed boolean")


def block_counts(blocks: DataFrame) -> DataFrame:
    """For each page with blocks, how many there are of each kind."""
    return blocks.groupBy("doc_id", "page").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("image", "table", "code")])


def consolidated(sections: DataFrame) -> DataFrame:
    """sections(doc_id, seq, type, content, breadcrumbs, start, end): runs of text that are no lists as one section, under the
    breadcrumbs of the run's last one; start and end are those of the section that ends the run, or of the last one."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    plain = (F.col("type") == "text") & ~T.trim_all(F.col("content")).rlike(r"^(?:[-*+]|\d+\.)")
    marked = sections.withColumn("plain", plain).withColumns({"n": F.sum((~F.col("plain")).cast("int")).over(order), "next_start": F.lead("start").over(order), "next_end": F.lead("end").over(order)})
    runs = marked.groupBy("doc_id", "n", "plain").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "content", "breadcrumbs", "start", "end", "next_start", "next_end"))).alias("s"))
    last = F.element_at("s", -1)
    return runs.select(
        "doc_id", F.get("s", F.lit(0))["seq"].alias("seq"), last["type"].alias("type"), F.array_join(F.transform("s", lambda x: x["content"]), "\n\n").alias("content"), last["breadcrumbs"].alias("breadcrumbs"),
        F.when(F.col("plain"), F.coalesce(last["next_start"], last["start"])).otherwise(last["start"]).alias("start"), F.when(F.col("plain"), F.coalesce(last["next_end"], last["end"])).otherwise(last["end"]).alias("end"),
    )
