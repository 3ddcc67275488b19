"""Queries over sources, sinks, stores, status tables, change events and graphs, made of the input tables. What is written
goes to the shared folder, so readers and writers are held against SQL by a round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, graph, mutations, search, store
from sparkloom.plans.registry import register
from sparkloom.session import read_table, temporary_path
from sparkloom.sources import readers, sinks
from sparkloom.streaming import cdc, events


# Sources and sinks.


@register("SELECT n_nationkey AS k, n_name || ' é“' AS name FROM nation")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "jsonl")
    sinks.write_json(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(" é“")).alias("name")), at)
    return readers.read_jsonl(spark, at, "k int, name string")


@register("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3")
def chunk_json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region: a list of chunks, an object with a list of them, a single chunk (its first nation's), or a text."""
    at = temporary_path(spark, "chunks")
    nations = read_table(spark, sf_dir, "nation")
    listed = nations.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))))).alias("l"))
    alone = nations.where("n_regionkey = 2").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value"))
    for n, rows in enumerate((listed.where("n_regionkey = 0").select(F.col("l").alias("value")), listed.where("n_regionkey = 1").select(F.concat(F.lit('{"chunks": '), "l", F.lit("}")).alias("value")), alone, listed.where("n_regionkey = 3").select(F.lit('"text"').alias("value")))):
        rows.repartition(max(1, rows.count())).write.text(f"{at}/{n}")
    return readers.read_chunk_json(spark, f"{at}/*", "k int, name string").select("k", "name")


@register("SELECT 'c' || c_custkey AS id, c_name AS text FROM customer")
def strict_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of fifty chunks."""
    at = temporary_path(spark, "strict")
    chunk = F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_name").alias("content_only"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    files = read_table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.to_json(F.collect_list(chunk)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return readers.read_strict_chunks(spark, f"{at}/*.txt", "id string, text string, content_only string, metadata map<string,string>").select("id", "text")


@register("SELECT 'n' || c_custkey AS chunk_id, 'customer' AS table_name, c_name AS text FROM customer WHERE c_acctbal > 0")
def knowledge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of fifty chunks, of which those without a text are passed over."""
    at = temporary_path(spark, "knowledge")
    chunk = F.struct(F.concat(F.lit("n"), "c_custkey").alias("chunk_id"), F.lit("customer").alias("table_name"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" ").alias("text"))
    files = read_table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.to_json(F.struct(F.collect_list(chunk).alias("chunks"))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return readers.read_knowledge(spark, f"{at}/*.txt").select("chunk_id", "table_name", "text")


@register("SELECT 'key_' || n_nationkey AS key, n_name || '=' || n_regionkey AS value FROM nation")
def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "settings")
    read_table(spark, sf_dir, "nation").select(F.explode(F.array(F.format_string("key_%d = %s=%d", "n_nationkey", "n_name", "n_regionkey"), F.lit("no pair"))).alias("value")).write.text(at)
    return readers.read_settings(spark, at)


@register("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0")
def filtered_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "csv")
    read_table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("c_custkey"), "c_name").write.option("header", True).csv(at)
    return readers.read_filtered_csv(spark, at, "c_custkey")


@register("SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def bulk_loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "bulk")
    for t in ("region", "nation"):
        read_table(spark, sf_dir, t).write.option("header", True).csv(f"{at}/{t}")
    loaded = readers.bulk_load(spark, {t: f"{at}/{t}" for t in ("nation", "region")}, ["region", "nation", "absent"])
    return loaded["nation"].join(loaded["region"], F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))


@register(
    """SELECT 'UPLOAD_' || p_partkey // 100 AS upload_id, 'VEND' || p_size % 3 AS vendor_id, p_name AS product_name, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS INT) END AS stock_quantity FROM part"""
)
def vendor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload files of three vendors: empty prices, and stocks with a fraction or that are no number."""
    at = temporary_path(spark, "vendors")
    price, stock = F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice").cast("string")).otherwise(""), F.when(F.col("p_partkey") % 4 > 0, F.concat("p_size", F.lit(".9"))).otherwise("many")
    line = F.concat(F.lit('"'), "p_name", F.lit('",'), price, F.lit(","), stock)
    named = F.format_string("VEND%d_%d.csv", F.col("p_size") % 3, F.floor(F.col("p_partkey") / 100))
    files = read_table(spark, sf_dir, "part").groupBy(named.alias("name")).agg(F.collect_list(line).alias("lines"))
    sinks.write_named_files(files.select("name", F.array_join(F.concat(F.array(F.lit("product_name,price,stock_quantity")), "lines"), "\n").alias("content")), at)
    return readers.read_vendor_csv(spark, f"{at}/VEND*.csv").select("upload_id", "vendor_id", "product_name", "price", "stock_quantity")


def _written_pages(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a page: twenty to a folder, page_1.md to page_20.md, those with odd ids in Windows-1252."""
    at = temporary_path(spark, "pages")
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    windows = F.concat(F.encode(F.regexp_replace(text, r"[^ -~\n]", ""), "UTF-8"), F.unhex(F.lit("20E9")))
    content = F.when(k % 2 == 1, windows).otherwise(F.encode(text, "UTF-8"))
    name = F.format_string("doc%d/pages/page_%d.md", F.floor(k / 20), k % 20 + 1)
    sinks.write_named_files(read_table(spark, sf_dir, "documents").select(name.alias("name"), content.alias("content")), at)
    return at


@register(
    r"""SELECT 'doc' || doc_id // 20 AS doc, CAST(doc_id % 20 + 1 AS INT) AS page, CASE WHEN doc_id % 2 = 1 THEN regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g') || ' é' ELSE coalesce(text, '') END AS text FROM documents"""
)
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two encodings, numbered by their names."""
    return readers.read_markdown_pages(spark, _written_pages(spark, sf_dir)).select("doc", "page", "text")


@register("SELECT 'doc' || doc_id // 20 AS doc, 'page_' || (doc_id % 20 + 1) || '.md' AS page, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY 'page_' || (doc_id % 20 + 1) || '.md') AS n FROM documents")
def pages_in_lexical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window  # noqa: PLC0415

    pages = readers.read_markdown_pages(spark, _written_pages(spark, sf_dir), natural=False)
    return pages.select("doc", "page", F.row_number().over(Window.partitionBy("doc").orderBy("page")).cast("long").alias("n"))


@register(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'naïve “€” ' || c_name WHEN 1 THEN 'naïve “€” ' || c_name ELSE 'na' || chr(129) || 've ' || c_name END AS text FROM customer"""
)
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with a UTF-8 mark, in Windows-1252, and with a byte that only Latin-1 has."""
    name = F.encode("c_name", "UTF-8")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.lit("naïve “€” "), "UTF-8"), name)
    windows = F.concat(F.unhex(F.lit("6E61EF766520938094 20".replace(" ", ""))), name)
    latin = F.concat(F.unhex(F.lit("6E6181766520")), name)
    step = F.col("c_custkey") % 3
    content = F.when(step == 0, marked).when(step == 1, windows).otherwise(latin)
    return read_table(spark, sf_dir, "customer").select("c_custkey", readers.decoded(content).alias("text"))


@register("SELECT c_custkey, c_name FROM customer")
def without_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "plain")
    sinks.write_without_reasoning(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("why").alias("reasoning"), F.lit("w").alias("judge_reasoning")), at)
    return spark.read.json(at)


@register("SELECT CAST(label AS VARCHAR) AS namespace, CAST(vec_id AS VARCHAR) AS id, CAST(CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END AS INT) AS created_at FROM embeddings")
def vector_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector table by namespace, and every tenth row put in again."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").cast("string").alias("id"), "embedding", F.lit(1).alias("created_at"))
    first, second = temporary_path(spark, "vectors"), temporary_path(spark, "vectors")
    sinks.write_vectors(rows, first)
    schema = rows.schema
    again = rows.where("cast(id as int) % 10 = 0")
    again = again.withColumn("created_at", F.lit(2)).unionByName(again)
    sinks.upsert_vectors(spark.read.schema(schema).parquet(first), again, second)
    return spark.read.schema(schema).parquet(second).select("namespace", "id", "created_at")


@register("SELECT 'VEND' || p_size % 3 AS vendor_id, 'U' || p_size % 2 AS upload_id, CAST(p_partkey AS VARCHAR) AS row_number, left(repeat(p_brand, 20), 100) AS description FROM part WHERE p_partkey % 4 = 0")
def error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = temporary_path(spark, "errors")
    null = F.lit(None).cast("string")
    judged = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("VEND"), F.col("p_size") % 3).alias("vendor_id"), F.concat(F.lit("U"), F.col("p_size") % 2).alias("upload_id"), F.col("p_partkey").alias("row_number"), F.repeat("p_brand", F.lit(20)).alias("description"),
        F.when(F.col("p_partkey") % 4 == 0, "error").otherwise("validated").alias("status"), *[null.alias(c) for c in cdc.ERROR_COLUMNS if c not in ("row_number", "description")],
    )
    cdc.write_error_files(judged, at)
    return spark.read.option("header", True).csv(at).select("vendor_id", "upload_id", "row_number", "description")


@register("SELECT DISTINCT 'errors/VEND' || p_size % 3 || '/U' || p_size % 2 || '_errors.csv' AS path FROM part")
def error_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cdc.error_file_path(F.concat(F.lit("VEND"), F.col("p_size") % 3), F.concat(F.lit("U"), F.col("p_size") % 2))
    return read_table(spark, sf_dir, "part").select(path.alias("path")).distinct()


@register(
    """SELECT 'doc_d' || c_custkey || '_' || left(md5('input/x/d' || c_custkey || '.PDF'), 8) AS document_id, 'PENDING' AS status, 1000 + 90 * 86400 AS ttl, 1000 + 180 * 86400 AS audit_ttl FROM customer WHERE c_custkey % 4 = 0"""
)
def created_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in the input folder and beside it, PDF and not, each told twice."""
    key = F.expr("concat(case when c_custkey % 2 = 0 then 'input/x/' else 'output/' end, 'd', c_custkey, case when c_custkey % 4 = 0 then '.PDF' else '.txt' end)")
    rows = read_table(spark, sf_dir, "customer").select(F.lit("b").alias("bucket"), key.alias("key"), F.lit(5).alias("size"))
    return readers.created_objects(rows.unionByName(rows), now=F.lit(1000)).select("document_id", "status", "ttl", "audit_ttl")


# Reading by key.


@register("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan(read_table(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000, ["c_custkey", "c_name"])


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_totalprice > 1000 ORDER BY n LIMIT 50")
def keyed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer's fifty newest orders, with a residual filter; the limit is the feature, and what is numbered is no more."""
    from pyspark.sql import Window  # noqa: PLC0415

    orders = read_table(spark, sf_dir, "orders")
    key = orders.agg(F.min("o_custkey")).first()[0]
    found = readers.query(orders, "o_custkey", key, "o_orderdate", F.col("o_totalprice") > 1000, ascending=False).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return found.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("n"))


@register("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def read_only_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_only_sql(spark, "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY 1", customer=read_table(spark, sf_dir, "customer"))


_STORE = "(SELECT 'user:' || CASE WHEN l.label < 3 THEN 'a' ELSE 'ab:' || l.label END AS namespace, 'k' || vec_id AS key, vec_id AS ts, label, embedding FROM embeddings l)"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("user:"), F.when(F.col("label") < 3, "a").otherwise(F.concat(F.lit("ab:"), "label")))
    return read_table(spark, sf_dir, "embeddings").select(name.alias("namespace"), F.concat(F.lit("k"), "vec_id").alias("key"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("value"), F.col("vec_id").alias("ts"), F.col("embedding").cast("array<double>").alias("embedding"))


@register(f"SELECT namespace, key, ts FROM {_STORE} WHERE namespace = 'user:a' AND key = (SELECT min(key) FROM {_STORE} WHERE namespace = 'user:a')")
def store_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir)
    key = rows.where("namespace = 'user:a'").agg(F.min("key")).first()[0]
    return store.get(rows, "user:a", key).select("namespace", "key", "ts")


@register(f"SELECT namespace, key, ts FROM {_STORE} WHERE starts_with(namespace, 'user:ab:') AND label <> 4 ORDER BY ts DESC LIMIT 15 OFFSET 5")
def store_newest_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below a namespace, newest first, a page of them; a namespace that only begins alike isn't meant."""
    return store.search(_store(spark, sf_dir), "user:ab", None, 15, 5, {"label": {"$ne": "4"}}).select("namespace", "key", "ts")


@register(
    f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT namespace, key, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS score FROM {_STORE}, q
    WHERE namespace = 'user:ab:5' ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, key LIMIT 7"""
)
def store_nearest_of_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir)
    query = rows.orderBy("ts").first()["embedding"]
    return store.search(rows, "user:ab:5", query, 7).select("namespace", "key", F.round("score", 5).alias("score"))


@register(f"SELECT DISTINCT array_to_string(string_split(namespace, ':')[:2], ':') AS namespace FROM {_STORE}")
def store_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.namespaces(_store(spark, sf_dir), 2)


@register(f"SELECT namespace, key FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ts DESC, key) AS n FROM {_STORE}) WHERE n <= 3")
def store_latest_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_episodes(_store(spark, sf_dir)).select("namespace", "key")


@register(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), c AS (SELECT 'k' || vec_id AS key, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s, vec_id FROM embeddings, q WHERE label % 2 = 0 AND vec_id % 3 > 0)
    SELECT key, 'answer ' || vec_id AS answer FROM (SELECT * FROM c ORDER BY s DESC, key LIMIT 1) WHERE s >= 0.05"""
)
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two namespaces, a third of them expired."""
    rows = read_table(spark, sf_dir, "embeddings")
    cache = rows.select(F.concat(F.lit("k"), "vec_id").alias("key"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("namespace"), F.concat(F.lit("answer "), "vec_id").alias("answer"), "embedding", F.when(F.col("vec_id") % 3 > 0, 100).otherwise(10).alias("expires_at"))
    return search.cache_lookup(cache, rows.orderBy("vec_id").first()["embedding"], "even", F.lit(50), 0.05).select("key", "answer")


@register(
    """SELECT CASE p_partkey % 3 WHEN 0 THEN 'i' || p_partkey WHEN 1 THEN 'c' || p_partkey ELSE 'chunk_' || left(md5(p_name), 16) END AS id, p_name AS text, CASE p_partkey % 2 WHEN 0 THEN 'table' ELSE 'text' END AS type, p_brand || ', x' AS key_phrases FROM part WHERE p_partkey % 5 > 0"""
)
def vector_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    chunks = read_table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, F.concat(F.lit("i"), k)).alias("id"), F.when(k % 3 == 1, F.concat(F.lit("c"), k)).otherwise("").alias("chunk_id"), F.col("p_name").alias("content"), F.lit("").alias("type"), F.when(k % 2 == 0, "table").alias("chunk_type"),
        null.alias("s3_uri"), F.array("p_brand", F.lit("x")).alias("key_phrases"), F.when(k % 5 > 0, F.array(F.lit(1.0))).when(k % 2 == 0, F.array().cast("array<double>")).alias("embedding"),
    )
    return search.vector_rows(chunks).select("id", "text", "type", "key_phrases")


@register(
    """WITH t AS (SELECT c_custkey, repeat('x', CAST(c_custkey % 9 * 500 AS INT)) AS t FROM customer), s AS (SELECT c_custkey, length(t) AS n FROM t) SELECT c_custkey, CAST(CASE WHEN n + 11 <= 1200 THEN n WHEN n * 3 // 4 + 11 <= 1200 THEN n * 3 // 4
    WHEN n // 2 + 11 <= 1200 THEN n // 2 WHEN n // 4 + 11 <= 1200 THEN n // 4 ELSE 1000 END AS INT) AS n FROM s"""
)
def compacted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.repeat(F.lit("x"), (F.col("c_custkey") % 9 * 500).cast("int"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.length(search.compact_metadata(text, 1200)).alias("n"))


@register(
    """WITH l AS (SELECT r_name AS kind, '- ' || n_name || ' (score:' || printf('%.3f', n_nationkey / 8.0) || '): text ' || n_nationkey AS line, n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey),
    g AS (SELECT kind, '## ' || kind || chr(10) || string_agg(line, chr(10) ORDER BY k DESC) AS b FROM l GROUP BY kind) SELECT string_agg(b, chr(10) || chr(10) ORDER BY kind) AS context FROM g"""
)
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return search.context_text(hits.select(F.col("r_name").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("text "), "n_nationkey").alias("text"), (F.col("n_nationkey") / 8.0).alias("score")))


@register(
    """WITH t AS (SELECT p_partkey, p_partkey / 4000.0 AS s, p_brand AS table_name, p_partkey % 4 AS k, p_name AS c, repeat(p_type, 40) || ' JOIN_CONDITION: a.x = b.' || p_size || ' ' || chr(10) || 'end' AS x FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY s DESC, x) AS n FROM t)
    SELECT CASE k WHEN 0 THEN 'table' WHEN 1 THEN 'column' ELSE 'relationship' END AS kind, table_name, CASE WHEN k = 1 THEN c ELSE '' END AS name, CASE WHEN k = 2 THEN CASE WHEN length(x) > 300 THEN left(x, 300) || '...' ELSE x END WHEN length(x) > 200 THEN left(x, 200) || '...' ELSE x END AS description,
    CASE WHEN k = 2 THEN 'a.x = b.' || (SELECT p_size FROM part p WHERE p.p_partkey = r.p_partkey) ELSE '' END AS join_condition, round(s, 3) AS score FROM r WHERE k IN (1, 2) OR k = 0 AND n = 1"""
)
def retrieved_context_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("p_partkey") % 4
    hits = read_table(spark, sf_dir, "part").select(
        (F.col("p_partkey") / 4000.0).alias("score"), F.col("p_brand").alias("table_name"), F.when(step == 0, "table").when(step == 1, "column").when(step == 2, "relationship").alias("entity_type"),
        F.when(step == 1, F.col("p_name")).alias("column_name"), F.concat(F.repeat("p_type", F.lit(40)), F.lit(" JOIN_CONDITION: a.x = b."), "p_size", F.lit(" \nend")).alias("text"),
    )
    return search.context_details(hits)


# Status tables.

_NOW = 1000


def _control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.control_rows(read_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "doc_id"), F.lit(_NOW))


@register(f"SELECT 'd' || doc_id AS document_id, 'PENDING' AS status, 'v1' AS processing_version, CAST(3 AS INT) AS max_retries, {_NOW} + 90 * 86400 AS ttl, CAST(5 AS INT) AS stages FROM documents")
def control_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control(spark, sf_dir).select("document_id", "status", "processing_version", "max_retries", "ttl", F.size("stage_status").alias("stages"))


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("document_id", 2, 20).cast("long") % 4
    rows = sinks.with_stage(_control(spark, sf_dir), "extract", "COMPLETED", k > 0, F.lit(_NOW + 1))
    rows = sinks.with_stage(rows, "chunk", "FAILED", k == 2, F.lit(_NOW + 2))
    return sinks.with_stage(rows, "load", "COMPLETED", k == 3, F.lit(_NOW + 3))


_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END"


@register(f"SELECT 'd' || doc_id AS document_id, {_STATUS} AS status, CASE WHEN doc_id % 4 > 0 THEN 'COMPLETED' ELSE 'PENDING' END AS extract, CASE WHEN doc_id % 4 = 2 THEN 'FAILED' ELSE 'PENDING' END AS chunk, CAST({_NOW} + doc_id % 4 AS INT) AS updated_at FROM documents")
def stage_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("stage_status")
    return _advanced(spark, sf_dir).select("document_id", "status", m["extract"].alias("extract"), m["chunk"].alias("chunk"), "updated_at")


@register(f"SELECT 'd' || doc_id AS document_id, 'PENDING' AS old_status, {_STATUS} AS new_status, {_NOW} + 9 AS timestamp, {_NOW} + 9 + 180 * 86400 AS ttl FROM documents WHERE doc_id % 4 > 0")
def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.audit_rows(_control(spark, sf_dir), _advanced(spark, sf_dir), F.lit(_NOW + 9)).select("document_id", "old_status", "new_status", "timestamp", "ttl")


@register(f"SELECT 'd' || doc_id AS document_id, {_STATUS} AS new_status FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE doc_id % 4 = 3)")
def audit_of_a_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read_table(spark, sf_dir, "documents").where("doc_id % 4 = 3").agg(F.min("doc_id")).first()[0]
    return sinks.audit_trail(sinks.audit_rows(_control(spark, sf_dir), _advanced(spark, sf_dir), F.lit(_NOW)), f"d{first}").select("document_id", "new_status")


@register(f"SELECT {_STATUS} AS status, count(*) AS n, sum(CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END)::BIGINT AS with_failed_stage FROM documents GROUP BY 1")
def pipeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.pipeline_totals(_advanced(spark, sf_dir))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("doc_id") % 5
    content = F.when(step == 0, "  ").when(step == 1, "AI description unavailable: x").otherwise(F.col("text"))
    return sinks.with_skips(read_table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")))


@register("SELECT doc_id, doc_id % 5 < 2 AS skipped, CASE doc_id % 5 WHEN 0 THEN 'empty content' WHEN 1 THEN 'placeholder' END AS skipped_reason, doc_id % 5 >= 2 AS has_vector FROM documents")
def skipped_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir).select("doc_id", "skipped", "skipped_reason", F.col("embedding").isNotNull().alias("has_vector"))


@register("SELECT count(*) AS total, sum(CASE WHEN doc_id % 5 >= 2 THEN 1 ELSE 0 END)::BIGINT AS embedded, sum(CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(CASE WHEN doc_id % 5 >= 2 THEN greatest(1, length(text) // 4) ELSE 0 END)::BIGINT AS tokens FROM documents")
def embedding_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.embedding_summary(_embedded(spark, sf_dir), 0.02).drop("cost")


@register("SELECT CAST(2 AS INT) AS dims, count(*) AS n, min(left(text, 80)) AS sample FROM documents WHERE doc_id % 5 >= 2")
def load_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.load_report(_embedded(spark, sf_dir).where("not skipped"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, c_mktsegment, c_acctbal FROM customer")
def partial_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every second customer; a segment that isn't allowed and a null balance change nothing."""
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit("X").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return mutations.update_fields(rows, new, "c_custkey", ["c_name", "c_acctbal"])


@register("SELECT c_custkey, c_name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 1 END AS INT) AS updated_at FROM customer")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(1).alias("updated_at"))
    before = after.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(F.col("c_name")))
    return mutations.touched(before, after, "c_custkey", F.lit(9)).select("c_custkey", "c_name", "updated_at")


@register("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 ELSE -1 END AS INT) AS processing_duration_seconds FROM orders")
def processing_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    done = F.timestamp_seconds(F.unix_timestamp(start) + F.col("o_orderkey") % 1000)
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("second", start).alias("processing_started_at"), F.when(F.col("o_orderkey") % 4 > 0, done).alias("processing_completed_at"), F.lit(-1).alias("processing_duration_seconds"))
    return mutations.with_duration(rows).select("o_orderkey", "processing_duration_seconds")


# Change events.


@register("SELECT event_id, CASE event_type WHEN 'click' THEN 'insert' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'remove' ELSE 'unknown' END AS action FROM events")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("event_type")
    raw = read_table(spark, sf_dir, "events").withColumn("eventName", F.when(name == "click", "INSERT").when(name == "view", "MODIFY").when(name == "purchase", "REMOVE").otherwise(name))
    return cdc.route(raw).select("event_id", "action")


@register(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'true' WHEN 4 THEN p_name || ',' || CAST(p_size AS VARCHAR) WHEN 5 THEN 'a,b' END AS value FROM part"""
)
def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, numbers, booleans, null, lists and sets with their tags."""
    tagged = F.expr("""case p_partkey % 6 when 0 then concat('{"S": "', p_name, '"}') when 1 then concat('{"N": "', p_size, '"}') when 2 then '{"BOOL": true}' when 3 then '{"NULL": true}'
        when 4 then concat('{"L": [{"S": "', p_name, '"}, {"N": "', p_size, '"}]}') else '{"SS": ["b", "a", "b"]}' end""")
    return read_table(spark, sf_dir, "part").select("p_partkey", cdc.wire_value(tagged).alias("value"))


@register(
    """SELECT 'U' || p_size % 5 AS upload_id, 'R' || p_partkey AS record_id, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'validated' ELSE 'error' END AS status, CASE WHEN p_partkey % 3 = 2 THEN 'INVALID_PRICE' WHEN p_partkey % 2 = 0 THEN 'old' END AS error_reason,
    CAST(CASE WHEN p_partkey % 3 > 0 THEN 7 END AS INT) AS processed_at FROM part"""
)
def statuses_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    keys = [F.concat(F.lit("U"), F.col("p_size") % 5).alias("upload_id"), F.concat(F.lit("R"), k).alias("record_id")]
    part = read_table(spark, sf_dir, "part")
    records = part.select(*keys, F.lit("pending").alias("status"), F.when(k % 2 == 0, "old").alias("error_reason"), null.alias("error_details"), F.lit(None).cast("int").alias("processed_at"))
    judged = part.where("p_partkey % 3 > 0").select(*keys, k.alias("row_number"), F.when(k % 3 == 1, "validated").otherwise("error").alias("status"), F.when(k % 3 == 2, "INVALID_PRICE").alias("error_type"), F.when(k % 3 == 2, "text").alias("error_message"))
    return cdc.written_back(records, judged, F.lit(7)).select("upload_id", "record_id", "status", "error_reason", "processed_at")


@register("SELECT CAST(date, DATE) AS date, metric_type, value FROM (SELECT CAST(ts AS DATE) AS date, event_type AS metric_type, value, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1".replace("CAST(date, DATE) AS date", "date"))
def daily_metric_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("metric_type"), "value", F.col("event_id").alias("seq"))
    return cdc.daily_metrics(rows).select("date", "metric_type", "value")


@register(
    """WITH o AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, ts, event_id FROM events), m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, min(s) AS begin, count(*) AS n FROM g GROUP BY user_id, session"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of the event stream in complete mode, so those still open at its end are there too."""
    found = events.run_to_table(events.session_stream(events.event_stream(spark, sf_dir)), ["user_id", "begin"], "complete")
    return found.select("user_id", "begin", "n")


# Graph.


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as study records: a nation as condition (none for every fifth), drug and site, its region as country."""
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read_table(spark, sf_dir, "supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey"))
    record = F.struct(
        F.concat(F.lit("T"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 5 > 0, F.array("n_name", F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("conditions"),
        F.array(F.struct(F.concat(F.lit("drug "), "n_name").alias("name"), F.lit("DRUG").alias("type"))).alias("drugs"), F.struct(F.col("r_name").alias("name"), F.lit("X").alias("class")).alias("sponsor"),
        F.array(F.struct(F.concat(F.lit("site "), "n_name").alias("name"), F.lit("c").alias("city"), F.when(F.col("s_suppkey") % 2 == 0, F.col("r_name")).alias("country"))).alias("sites"),
        F.array(F.struct(F.lit("m").alias("measure"), F.lit("t").alias("time_frame")), F.struct(F.lit("m").alias("measure"), F.lit("u").alias("time_frame"))).alias("outcomes"),
    )
    return graph.parse_records(rows.select(F.to_json(record).alias("json")).unionByName(spark.createDataFrame([("no json",)], "json string")))


_G = "(SELECT 'T' || s_suppkey AS id, s_suppkey AS k, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
_NODES = f"""(SELECT 'Trial' AS label, id AS key FROM {_G} UNION SELECT 'TrialCategory', CASE WHEN k % 5 > 0 THEN n_name ELSE 'Unknown' END FROM {_G} UNION SELECT 'Disease', n_name FROM {_G} WHERE k % 5 > 0
    UNION SELECT 'Drug', 'drug ' || n_name FROM {_G} UNION SELECT 'Sponsor', r_name FROM {_G} UNION SELECT 'Site', 'site ' || n_name FROM {_G} UNION SELECT 'Country', r_name FROM {_G} WHERE k % 2 = 0
    UNION SELECT 'Outcome', id || '#1' FROM {_G} UNION SELECT 'Outcome', id || '#2' FROM {_G})"""


@register(f"SELECT label, key FROM {_NODES}")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_records(spark, sf_dir)).select("label", "key")


@register(
    f"""SELECT id AS src, 'BELONGS_TO' AS rel, CASE WHEN k % 5 > 0 THEN n_name ELSE 'Unknown' END AS dst FROM {_G} UNION SELECT id, 'TARGETS', n_name FROM {_G} WHERE k % 5 > 0 UNION SELECT id, 'USES', 'drug ' || n_name FROM {_G}
    UNION SELECT id, 'SPONSORED_BY', r_name FROM {_G} UNION SELECT id, 'CONDUCTED_IN', r_name FROM {_G} WHERE k % 2 = 0 UNION SELECT id, 'LOCATED_AT', 'site ' || n_name FROM {_G} WHERE k % 2 = 0
    UNION SELECT 'site ' || n_name, 'IN_COUNTRY', r_name FROM {_G} WHERE k % 2 = 0 UNION SELECT id, 'MEASURES', id || '#1' FROM {_G} UNION SELECT id, 'MEASURES', id || '#2' FROM {_G}"""
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_records(spark, sf_dir))


@register(f"SELECT label, count(*) AS n FROM {_NODES} GROUP BY 1")
def graph_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(graph.nodes(_records(spark, sf_dir)))


@register("SELECT 'Supplier' AS label, CAST(s_nationkey AS VARCHAR) AS key, count(*) AS count FROM supplier GROUP BY 2 HAVING count(*) > 1")
def graph_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read_table(spark, sf_dir, "supplier").select(F.lit("Supplier").alias("label"), F.col("s_nationkey").cast("string").alias("key"))
    return graph.duplicate_keys(nodes)


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 'none' AS absent FROM events")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", graph.dig(F.col("props"), "k").alias("k"), graph.dig(F.col("props"), "a.b", "none").alias("absent"))


@register("SELECT n_nationkey AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name LIKE '%A%'")
def graph_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a:Nation)-[IN]->(b:Region) where a has an A."""
    nations = read_table(spark, sf_dir, "nation").select(F.lit("Nation").alias("label"), F.col("n_nationkey").cast("string").alias("key"), "n_name", "n_regionkey")
    regions = read_table(spark, sf_dir, "region").select(F.lit("Region").alias("label"), F.col("r_name").alias("key"), "r_regionkey")
    edges = nations.join(regions.select(F.col("key").alias("dst"), "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("key").alias("src"), F.lit("IN").alias("rel"), "dst")
    nodes = nations.where(F.contains("n_name", F.lit("A"))).select("label", "key").unionByName(regions.select("label", "key"))
    return graph.match(nodes, edges, ("a", "Nation"), ("IN", ">", "b", "Region")).select(F.col("a").cast("long").alias("a"), "b")


# Evaluation.


@register("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("element_at(array('0.25', '7', '-3', 'good', 'NaN'), cast(p_partkey % 5 as int) + 1)")
    return read_table(spark, sf_dir, "part").select("p_partkey", evaluation.judge_score(raw).alias("score"))


@register(
    """WITH e AS (SELECT doc_id, string_split(text, chr(10))[:3] AS c, row_number() OVER (ORDER BY doc_id) AS r FROM documents), p AS (SELECT doc_id, r, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS k FROM e WHERE r <= 100)
    SELECT doc_id || '_d' || k AS id, left(x, 8000) AS text, r <= 30 AS in_golden FROM p"""
)
def evaluation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of the first hundred examples; a limit is the feature."""
    docs = read_table(spark, sf_dir, "documents")
    examples = docs.select(F.col("doc_id").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.slice(F.split("text", "\n"), 1, 3).alias("contexts"))
    return store.golden_and_corpus(examples, 30, 100)[1]


@register(
    """WITH e AS (SELECT doc_id, left(text, 30) AS q, string_split(text, chr(10))[:3] AS c FROM documents ORDER BY doc_id LIMIT 30) SELECT doc_id AS id, q AS input, left(q, 2000) AS reference, array_to_string(list_transform(range(0, len(c)), lambda k: doc_id || '_d' || k), ',') AS context_ids FROM e"""
)
def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    start = F.left("text", F.lit(30))
    examples = docs.select(F.col("doc_id").alias("id"), start.alias("question"), start.alias("answer"), F.slice(F.split("text", "\n"), 1, 3).alias("contexts"))
    return store.golden_and_corpus(examples, 30, 100)[0].select("id", "input", "reference", F.array_join("context_ids", ",").alias("context_ids"))
