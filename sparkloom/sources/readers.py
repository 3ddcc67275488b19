"""Readers: pages, texts of unknown encoding, JSON of several shapes, CSV, settings. They go through Spark's file
sources, and through folders where files are many and small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources import folders


def page_order(path: Column) -> Column:
    """The first number in a file's name, or 0: page_2 comes before page_10."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.regexp_extract(name, r"\d+", 0).try_cast("int"), F.lit(0))


def _windows_signs() -> tuple[str, str]:
    """The characters that Windows-1252 has in place of Latin-1's controls, as two strings of equal length."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def decoded(content: Column) -> Column:
    """UTF-8, without a mark, where the bytes are; else Windows-1252; else, with bytes that it lacks, Latin-1."""
    latin, (controls, signs) = F.decode(content, "ISO-8859-1"), _windows_signs()
    windows = F.when(latin.rlike("[\\x81\\x8d\\x8f\\x90\\x9d]"), latin).otherwise(F.translate(latin, controls, signs))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(windows)
    return F.regexp_replace(text, "^\ufeff", "")


def read_texts(spark: SparkSession, *globs: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.format("binaryFile").load(list(globs)).select("path", decoded(F.col("content")).alias("text"))


LEVELS = ("*.md", "pages/*.md", "*/pages/*.md")


def read_markdown_pages(spark: SparkSession, root: str, natural: bool = True) -> DataFrame:
    """Pages of a folder: doc (the folder's name), page, path, text. *.md, else pages/*.md, else */pages/*.md: the first level
    that has any. Files are listed and read by the tasks, if Arrow knows the file system."""
    root = folders.qualified(spark, root).rstrip("/")
    if folders.known(root):
        level = next((x for x in LEVELS[:-1] if not folders.found(spark, root, x).isEmpty()), LEVELS[-1])
        rows = folders.contents(spark, root, level).select("path", decoded(F.col("content")).alias("text"))
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        level = next((x for x in LEVELS if files.globStatus(hadoop.Path(f"{root}/{x}"))), None)
        rows = read_texts(spark, f"{root}/{level}") if level else spark.createDataFrame([], "path string, text string")
    parts = F.split("path", "/")
    doc = F.when(F.element_at(parts, -2) == "pages", F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    return rows.select(doc.alias("doc"), page_order(F.col("path")).alias("page") if natural else F.element_at(parts, -1).alias("page"), "path", "text")


def read_csv_files(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """Rows of many small CSV files in UTF-8 with headers, whose quotes are doubled; blank lines are skipped. Files are listed and
    read by the tasks, if Arrow knows the file system."""
    root = folders.qualified(spark, root).rstrip("/")
    if not folders.known(root):
        return spark.read.option("header", True).option("escape", '"').schema(schema).csv(f"{root}/{glob}")
    lines = folders.contents(spark, root, glob).select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("n", "line")).where((F.col("n") > 0) & (F.trim("line") != ""))
    return lines.select(F.from_csv("line", schema, {"escape": '"'}).alias("r")).select("r.*")


def read_chunk_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Chunks of files that hold a list of them, an object with a list under 'chunks', or one chunk (an object with one
    of the fields at least); other shapes give none."""
    element = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = read_texts(spark, path)
    listed = F.from_json("text", T.ArrayType(element))
    inside = F.from_json("text", T.StructType([T.StructField("chunks", T.ArrayType(element))]))["chunks"]
    is_list = F.ltrim("text").startswith("[")
    one = F.from_json("text", element)
    alone = F.when(F.get_json_object("text", "$.chunks").isNull() & (F.to_json(one) != "{}"), F.array(one))
    return raw.select("path", F.posexplode(F.when(is_list, listed).otherwise(F.coalesce(inside, alone))).alias("n", "c")).select("path", "n", "c.*")


def read_strict_chunks(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ("id", "text", "content_only", "metadata")) -> DataFrame:
    """As read_chunk_json, but a chunk without a required field is an error."""
    rows = read_chunk_json(spark, path, schema)
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])), ", ")
    checked = F.when(absent != "", F.raise_error(F.concat(F.lit("chunk without "), absent))).otherwise(F.lit(True))
    return rows.where(checked)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_knowledge(spark: SparkSession, glob: str) -> DataFrame:
    """Knowledge-base chunks of semantic_*.json files, without those that have no text."""
    schema = "chunk_id string, chunk_type string, entity_type string, table_name string, column_name string, text string, metadata map<string,string>, keywords array<string>"
    return read_chunk_json(spark, glob, schema).where(F.coalesce(F.trim("text"), F.lit("")) != "")


# The columns of a vendor's file.
UPLOAD_COLUMNS = (
    "vendor_product_id", "product_name", "category", "subcategory", "description", "sku", "brand", "price", "compare_at_price", "stock_quantity", "unit", "weight_kg", "dimensions_cm", "image_url",
)
DECIMALS, WHOLE = ("price", "compare_at_price", "weight_kg"), ("stock_quantity",)


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed upload rows: bad or empty numbers are null, '3.9' pieces are 3; numbered from 1 in file order, with ids from the
    file's name (vendor before the first underscore)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # a file with quoted line ends is read by one task, so ids that rise give its order
    rows = raw.select("*", name.alias("__file"), F.monotonically_increasing_id().alias("__at"))
    from pyspark.sql import Window  # noqa: PLC0415

    number = F.row_number().over(Window.partitionBy("__file").orderBy("__at"))
    typed = []
    for c in UPLOAD_COLUMNS:
        value = F.nullif(F.trim(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
        typed.append((value.try_cast("double") if c in DECIMALS else value.try_cast("double").cast("int") if c in WHOLE else value).alias(c))
    stem = F.regexp_replace("__file", r"\.csv$", "")
    return rows.withColumn("row_number", number).select(
        F.concat(F.lit("UPLOAD_"), F.regexp_replace(stem, "^[^_]*_", "")).alias("upload_id"), F.split(stem, "_")[0].alias("vendor_id"), F.format_string("REC_%05d", "row_number").alias("record_id"), "row_number", *typed
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of key=value lines; the value may have further equals signs."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("=")))
    return lines.select(F.trim(F.split("value", "=", 2)[0]).alias("key"), F.trim(F.split("value", "=", 2)[1]).alias("value"))


def read_filtered_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).where(F.coalesce(F.trim(key), F.lit("")) != "")


def bulk_load(spark: SparkSession, paths: dict[str, str], order: list[str]) -> dict[str, DataFrame]:
    """CSV files with headers as tables, in the order in which they refer to each other; empty fields are null."""
    return {name: spark.read.option("header", True).option("inferSchema", True).option("nullValue", "").csv(paths[name]) for name in order if name in paths}


def created_objects(events: DataFrame, prefix: str = "input/", suffix: str = ".pdf", now: Column | None = None) -> DataFrame:
    """events(bucket, key, size) of created objects: those in the folder with the ending (any case), once each, as control
    records that live for 90 days; the audit of their arrival lives for 180."""
    now = F.unix_timestamp() if now is None else now
    name = F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"\.[^.]*$", "")
    chosen = events.where(F.col("key").startswith(prefix) & F.lower("key").endswith(suffix)).dropDuplicates(["bucket", "key"])
    return chosen.select(F.concat(F.lit("doc_"), name, F.lit("_"), F.left(F.md5("key"), F.lit(8))).alias("document_id"), "bucket", "key", "size", F.lit("PENDING").alias("status"), (now + 90 * 86400).alias("ttl"), (now + 180 * 86400).alias("audit_ttl"))


def read_new_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """A stream of created files with that ending (any case): id from the path, so a file keeps it; PENDING rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    chosen = files.where(F.lower("path").endswith(suffix))
    return chosen.select(F.concat(F.lit("doc_"), F.left(F.md5("path"), F.lit(16))).alias("document_id"), "path", "modificationTime", F.lit("PENDING").alias("status"), "content")


def scan(table: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = table if where is None else table.where(where)
    return rows if columns is None else rows.select(*columns)


def query(table: DataFrame, key: str, value, sort: str, residual: Column | None = None, ascending: bool = True) -> DataFrame:
    """Rows of one partition key by the sort key, residual filter after."""
    rows = table.where(F.col(key) == value)
    rows = rows if residual is None else rows.where(residual)
    return rows.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc())


def read_only_sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Runs a query that only reads; one with a writing word is refused before it is planned."""
    import re  # noqa: PLC0415

    from sparkloom.functions.text import WRITE_WORDS  # noqa: PLC0415

    if m := re.search(rf"\b({'|'.join(WRITE_WORDS)})\b", statement.lower()):
        raise ValueError(f"Write op '{m[1]}' blocked - read-only enforced")
    return spark.sql(statement, **tables)
