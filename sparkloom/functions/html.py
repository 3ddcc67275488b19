"""HTML pages: what can be had by patterns is a column expression, the rest is one parse a page (standard library)."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import spread

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "template"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCK = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "form", "main", "body"}


class Node:
    """Nodes don't know their parents, so that a tree without a cycle goes as soon as its page is done."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def all(self, *tags):
        for c in self.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    yield c
                yield from c.all(*tags)

    def text(self, sep=" "):
        return " ".join(sep.join(self._pieces()).split())

    def _pieces(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in SKIPPED:
                yield from c._pieces()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("document")]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        if self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = len(self.open) - 1
        while at > 0 and self.open[at].tag != tag:
            at -= 1
        if at > 0:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def links(tree: Node, base: str) -> list[dict]:
    out = []
    for a in tree.all("a"):
        if href := a.attrs.get("href"):
            url = urljoin(base, href)
            out.append({"url": url, "text": a.text() or "[No text]", "is_internal": urlsplit(url).netloc == urlsplit(base).netloc})
    return out


def tables(tree: Node) -> list[dict]:
    """Header from thead, or from a first row that begins with th (which stays a data row too); rows fitted to its width."""
    out = []
    for n, table in enumerate(tree.all("table"), 1):
        head = next(table.all("thead"), None)
        inside = set(map(id, head.all("tr"))) if head else set()
        rows = [(r, [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]) for r in table.all("tr")]
        header = [c.text() for c in head.all("th", "td")] if head else []
        body = [[c.text() for c in cells] for r, cells in rows if cells and id(r) not in inside]
        if not header and rows and rows[0][1] and rows[0][1][0].tag == "th":
            header = [c.text() for c in rows[0][1]]
        if header:
            body = [(r + [""] * len(header))[: len(header)] for r in body]
        if header or body:
            out.append({"table_no": n, "header": header, "rows": body})
    return out


def forms(tree: Node) -> list[dict]:
    return [{"action": f.attrs.get("action", ""), "method": f.attrs.get("method", "get").upper(), "fields": [f"{i.tag}:{i.attrs.get('type', 'text' if i.tag == 'input' else i.tag)}:{i.attrs.get('name', '')}" for i in f.all("input", "select", "textarea")]} for f in tree.all("form")]


def media(tree: Node, base: str) -> list[dict]:
    return [{"kind": m.tag, "url": urljoin(base, m.attrs["src"])} for m in tree.all("video", "audio", "source", "iframe", "img") if m.attrs.get("src")]


def _content_root(tree: Node) -> Node:
    by = [next(tree.all("main"), None), next(tree.all("article"), None)]
    divs = list(tree.all("div"))
    by += [next((d for d in divs if d.attrs.get("id") == "content"), None), next((d for d in divs if "content" in d.attrs.get("class", "").split()), None), next(tree.all("body"), None)]
    return next((b for b in by if b is not None), tree)


def blocks(tree: Node, base: str) -> list[dict]:
    """Headings, paragraphs, lists (own items only), images, quotes and code, in order; containers are entered."""
    out: list[dict] = []

    def walk(node):
        for c in node.children:
            if not isinstance(c, Node) or c.tag in SKIPPED:
                continue
            kind = None
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                kind, text = "heading" + c.tag[1], c.text()
            elif c.tag == "p":
                kind, text = "paragraph", c.text()
            elif c.tag in ("ul", "ol"):
                items = [i.text() for i in c.children if isinstance(i, Node) and i.tag == "li"]
                kind, text = "list", "\n".join(i for i in items if i)
            elif c.tag == "img":
                kind, text = "image", f"{c.attrs.get('alt', '')} {urljoin(base, c.attrs.get('src', ''))}".strip()
            elif c.tag == "blockquote":
                kind, text = "quote", c.text()
            elif c.tag == "pre":
                kind, text = "code", "".join(c._pieces()).strip()
            else:
                walk(c)
                continue
            if text:
                out.append({"type": kind, "content": text})

    walk(_content_root(tree))
    return out


#: Pages whose finds are held at once.
PAGES = 100
ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def _parsed(pages: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` finds on each page, numbered from 1. Pages are dealt out anew, as a parse costs far more than its shuffle
    and a small file, or one row group, would be one task's work."""
    fields = [p.strip().split(" ") for p in schema.split(",")]

    def scan(batches):
        out = pa.schema([("page_id", pa.int64()), ("n", pa.int32()), *[(name, ARROW[kind]) for name, kind in fields]])
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                rows = zip(*[c.to_pylist() for c in batch.slice(at, PAGES).columns], strict=True)
                found = [{"page_id": k, "n": i, **x} for k, url, html in rows for i, x in enumerate(make(parse(html), url or ""), 1)]
                yield pa.RecordBatch.from_pylist(found, schema=out)

    return spread(pages.select("page_id", "url", "html"), "page_id").mapInArrow(scan, f"page_id long, n int, {schema}")


def page_links(pages: DataFrame) -> DataFrame:
    return _parsed(pages, links, "url string, text string, is_internal boolean")


def page_tables(pages: DataFrame) -> DataFrame:
    return _parsed(pages, lambda t, b: tables(t), "table_no int, header array<string>, rows array<array<string>>")


def page_forms(pages: DataFrame) -> DataFrame:
    return _parsed(pages, lambda t, b: forms(t), "action string, method string, fields array<string>")


def page_media(pages: DataFrame) -> DataFrame:
    return _parsed(pages, media, "kind string, url string")


def page_blocks(pages: DataFrame) -> DataFrame:
    return _parsed(pages, blocks, "type string, content string")


def page_text(pages: DataFrame) -> DataFrame:
    return _parsed(pages, lambda t, b: [{"text": t.text()}], "text string").drop("n")


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first such tag, without inner tags, spaces collapsed; '' if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " "))


def meta_content(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta\s+(?:name|property)=\"{name}\"\s+content=\"([^\"]*)\"", 1)


def metadata(html: Column) -> Column:
    return F.struct(tag_text(html, "title").alias("title"), meta_content(html, "description").alias("description"), meta_content(html, "keywords").alias("keywords"), meta_content(html, "og:title").alias("og_title"))


def report(pages: DataFrame) -> DataFrame:
    """A markdown report of each page, its sections in fixed order: title, source, content, links."""
    parts = page_blocks(pages).withColumn("line", F.when(F.col("type").startswith("heading"), F.concat(F.repeat(F.lit("#"), F.right("type", F.lit(1)).cast("int")), F.lit(" "), "content")).otherwise(F.col("content")))
    body = parts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n\n").alias("body"))
    refs = page_links(pages).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text", "url"))), lambda s: F.concat(F.lit("- ["), s["text"], F.lit("]("), s["url"], F.lit(")"))), "\n").alias("refs"))
    rows = pages.select("page_id", "url", tag_text(F.col("html"), "title").alias("title")).join(body, "page_id", "left").join(refs, "page_id", "left")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Source: "), "url"), F.lit("## Content"), "body", F.lit("## Links"), "refs")
    return rows.select("page_id", text.alias("markdown"))
