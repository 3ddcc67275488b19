"""Operators on items that a document parser has already found: ids, headers, tables, code, captions, page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import trim_all


def unique_ids(items: DataFrame) -> DataFrame:
    """items(doc_id, page, type, seq): id as p{page}_{type}_{n}."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "type").orderBy("seq"))
    return items.withColumn("id", F.format_string("p%d_%s_%d", "page", "type", n))


def cell_dump(table: Column) -> Column:
    """A markdown table as lines of 'column: value | ...': no empty columns, separator rows or empty cells."""
    rows = F.filter(F.split(table, "\n"), lambda r: F.contains(r, F.lit("|")))
    cells = lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    header = cells(F.get(rows, F.lit(0)))
    body = F.filter(F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows))), lambda r: ~F.regexp_replace(r, r"[\s|]", "").rlike(r"^[-:]*$"))
    pair = lambda r: F.filter(F.zip_with(header, cells(r), lambda h, v: F.when((h != "") & ~F.coalesce(v, F.lit("")).isin("", "nan", "NaN", "None"), F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
    lines = F.filter(F.transform(body, lambda r: F.array_join(pair(r), " | ")), lambda x: x != "")
    return F.array_join(lines, "\n")


def table_body(table: Column, most: int = 3000) -> Column:
    """struct(is_large, body): large tables are given as cells."""
    large = F.length(table) > most
    return F.struct(F.when(large, "yes").otherwise("no").alias("is_large"), F.when(large, cell_dump(table)).otherwise(table).alias("body"))


def clamp_description(text: Column, least: int = 20, most: int = 500) -> Column:
    """At most ``most`` characters with an ellipsis; null if there are too few to say anything."""
    clean = trim_all(text)
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 3)), F.lit("..."))).when(F.length(clean) >= least, clean)


def code_block(text: Column) -> Column:
    """The text in a fence with its language, if it looks like code; else null."""
    t = text
    has = lambda s: F.contains(t, F.lit(s))
    looks = t.startswith("    ") | t.startswith("\t") | has("```") | has("def ") | has("class ") | has("import ") | has("function ") | (has("{") & has("}") & has(";"))
    python = F.contains(F.lower(t), F.lit("python")) | has("def ") | has("import ")
    script = has("function") | has("const ") | has("let ")
    language = F.when(python, "python").when(script, "javascript").otherwise("")
    return F.when((F.length(trim_all(t)) >= 3) & looks, F.concat(F.lit("```"), language, F.lit("\n"), trim_all(t), F.lit("\n```")))


def with_breadcrumbs(items: DataFrame, deepest: int = 6) -> DataFrame:
    """items(doc_id, seq, type, level, text): breadcrumbs under which each item stands. A header of a level ends those of that
    level and below; parents that were skipped aren't filled in. Carried across pages; levels beyond ``deepest`` count as it.

    A header stands one place further than the one before it, but no further than its level. Counted from the first, the
    t-th header's place is t + min(0, level - s) over all headers s up to it, which is a running minimum. A place's header
    is the last one there, unless one of a smaller place came after it."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("type") == "header"
    counted = items.withColumn("__t", F.count_if(header).over(order))
    level = F.least(F.greatest(F.col("level").cast("long"), F.lit(1)), F.lit(deepest))
    placed = counted.withColumn("__place", F.when(header, F.col("__t") + F.least(F.lit(0), F.min(F.when(header, level - F.col("__t"))).over(order))))
    last = {p: F.max(F.when(F.col("__place") == p, F.struct(F.col("__t").alias("t"), F.col("text").alias("x")))).over(order) for p in range(1, deepest + 1)}
    ended = {p: F.max(F.when(F.col("__place") < p, F.col("__t"))).over(order) for p in range(2, deepest + 1)}
    rows = placed.withColumns({f"__l{p}": c for p, c in last.items()} | {f"__e{p}": c for p, c in ended.items()})
    kept = [F.when(F.col("__l1").isNotNull(), F.array("__l1.x"))] + [F.when(F.col(f"__l{p}").isNotNull() & (F.coalesce(F.col(f"__e{p}"), F.lit(0)) < F.col(f"__l{p}.t")), F.array(f"__l{p}.x")) for p in range(2, deepest + 1)]
    crumbs = F.concat(*[F.coalesce(k, F.array().cast("array<string>")) for k in kept])
    return rows.select(*items.columns, crumbs.alias("breadcrumbs"))


def heading_line(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), text)


def with_captions(items: DataFrame) -> DataFrame:
    """Each item with the text of a caption that comes right after it."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    follows = F.lead("type").over(order) == "caption"
    return items.withColumn("caption", F.when(follows & (F.col("type") != "caption"), F.lead("text").over(order)))


def captions_first(items: DataFrame) -> DataFrame:
    """A visual that is followed by a text beginning with Exhibit, Figure or Table changes places with it."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    trigger = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*(Exhibit|Figure|Table)\b") & F.col("type").isin("text", "caption")
    marked = items.withColumn("__t", trigger).withColumn("__v", F.col("type").isin("image", "table", "picture", "figure"))
    seq = F.when(F.col("__v") & F.coalesce(F.lead("__t").over(order), F.lit(False)), F.lead("seq").over(order)).when(F.col("__t") & F.coalesce(F.lag("__v").over(order), F.lit(False)), F.lag("seq").over(order))
    return marked.withColumn("seq", F.coalesce(seq, F.col("seq"))).drop("__t", "__v")


def assembled_pages(items: DataFrame) -> DataFrame:
    """items(doc_id, page, seq, output): page texts, outputs in order with a blank line between."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "output")))
    return items.where("output is not null").groupBy("doc_id", "page").agg(F.array_join(F.transform(pieces, lambda p: p["output"]), "\n\n").alias("text"))


def table_runs(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text): consecutive lines with a pipe and more than three characters are a table; tables are numbered
    through the document."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id", "page").orderBy("n")
    rows = lines.where(F.contains("line", F.lit("|")) & (F.length(F.trim("line")) > 3))
    runs = rows.withColumn("run", F.col("n") - F.row_number().over(order))
    tables = runs.groupBy("doc_id", "page", "run").agg(F.min("n").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("table"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "first_line"))
    return tables.select("doc_id", "page", number.alias("table_no"), "first_line", "table")


# How a parser's element categories are written in markdown.
MARKDOWN = {"Title": "# ", "Header": "## ", "ListItem": "- ", "FigureCaption": "*"}


def element_markdown(category: Column, text: Column) -> Column:
    lead = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in MARKDOWN.items()], F.lit(""))
    return F.concat(lead, text, F.when(category == "FigureCaption", "*").otherwise(""))


def section_statistics(sections: DataFrame) -> DataFrame:
    """sections(type, content, breadcrumbs): count and mean size of each type, least, largest and mean depth."""
    return sections.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 1).alias("mean_size"), F.min(F.size("breadcrumbs")).alias("least_depth"), F.max(F.size("breadcrumbs")).alias("most_depth"), F.round(F.avg(F.size("breadcrumbs")), 1).alias("mean_depth"))


def table_cells(tables: DataFrame) -> DataFrame:
    """tables(doc_id, page, table_no, table) in markdown: doc_id, page, table_no, row (from 0, the header), cells. The line under
    the header is left out, signs at a line's ends aren't cells, and a pipe after a backslash is part of its cell."""
    lines = tables.select("doc_id", "page", "table_no", F.filter(F.split("table", "\n"), lambda x: ~x.rlike(r"^[\s|:-]*-[\s|:-]*$") & (F.trim(x) != "")).alias("lines"))
    inner = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\|", ""), r"(?<!\\)\|$", "")
    cells = lambda x: F.transform(F.split(inner(x), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return lines.select("doc_id", "page", "table_no", F.posexplode(F.transform("lines", cells)).alias("row", "cells"))


def table_files(tables: DataFrame) -> DataFrame:
    """A CSV file for each table: name (doc_{id}/tables/table_001_page_001.csv) and content. Cells with a comma, a quote or a line
    end are quoted; a table's rows are few, and are gathered for its file."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    rows = table_cells(tables).select("doc_id", "page", "table_no", F.struct("row", F.array_join(F.transform("cells", quoted), ",").alias("line")).alias("r"))
    files = rows.groupBy("doc_id", "page", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("content"))
    return files.select(F.format_string("doc_%s/tables/table_%03d_page_%03d.csv", F.col("doc_id").cast("string"), "table_no", "page").alias("name"), F.concat("content", F.lit("\n")).alias("content"))


def element_texts(elements: DataFrame) -> DataFrame:
    """elements(doc_id, seq, category, text): the text of each document, titles as headings, narrative set off by blank lines,
    list items with a dash, and how many characters, words and lines it has. Categories are judged by what their names hold."""
    has = lambda s: F.contains("category", F.lit(s))
    text = F.coalesce("text", F.lit(""))
    piece = (
        F.when(has("Title"), F.concat(F.lit("\n# "), text, F.lit("\n"))).when(has("Text"), F.concat(F.lit("\n"), text, F.lit("\n")))
        .when(has("ListItem"), F.concat(F.lit("- "), text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n")))
    )
    pieces = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", piece.alias("p")))).alias("p"))
    whole = pieces.select("doc_id", F.array_join(F.transform("p", lambda x: x["p"]), "").alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return whole.select("doc_id", "text", F.length("text").alias("characters"), words.alias("words"), F.size(F.split("text", "\n")).alias("lines"))


def element_tables(elements: DataFrame) -> DataFrame:
    """elements(doc_id, seq, category, text, html): the tables of each document, numbered from 1: their HTML, or their text."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return elements.where("category = 'Table'").select("doc_id", number.alias("table_no"), F.coalesce("html", "text").alias("content"))


def element_figures(elements: DataFrame) -> DataFrame:
    """elements(doc_id, seq, category, text): the figures of each document, numbered from 1, with the caption that follows."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    caption = F.when(F.lead("category").over(order) == "FigureCaption", F.lead("text").over(order))
    found = elements.withColumn("caption", caption).where(F.col("category").isin("Image", "Figure", "Picture"))
    return found.select("doc_id", F.row_number().over(order).alias("figure_no"), F.coalesce("caption", "text").alias("caption"))
