"""Enrichment, extraction and store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import enrichment, extraction, search, store
from sparkloom.plans.registry import register
from sparkloom.session import read_table


@register(
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
    SELECT user_id, event_id, CAST(r AS BIGINT) AS place FROM r WHERE r <= 10 AND value >= 90"""
)
def top_phrases_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each user by score, of which those over the threshold stay: cut first, then tested."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: F.struct(s["event_id"].cast("string").alias("text"), s["value"].alias("score")))
    lists = read_table(spark, sf_dir, "events").groupBy("user_id").agg(items.alias("phrases"))
    found = lists.select("user_id", F.posexplode(enrichment.key_phrases(F.col("phrases"), 10, 90.0)).alias("n", "event_id"))
    return found.select("user_id", F.col("event_id").cast("long").alias("event_id"), (F.col("n") + 1).cast("long").alias("place"))


@register(
    """WITH c AS (SELECT user_id, event_id, event_type, 'K' || json_extract_string(props, '$.k') AS t, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events),
    m AS (SELECT user_id, event_type, lower(t) AS k, min(event_id) AS first_seen, max(value) AS confidence FROM c WHERE r <= 20 GROUP BY 1, 2, 3)
    SELECT user_id, event_type AS type, count(*) AS n, max(confidence) AS best FROM m GROUP BY 1, 2"""
)
def capped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("text"), F.col("value").alias("confidence"))
    found = enrichment.organised_entities(rows, 20).select("chunk_id", F.explode("entities").alias("type", "found"))
    return found.select(F.col("chunk_id").alias("user_id"), "type", F.size("found").cast("long").alias("n"), F.array_max(F.transform("found", lambda e: e["confidence"])).alias("best"))


@register(
    """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) AS i FROM documents)
    SELECT doc_id, arg_max(w, length(w) * 1000000 + i) AS word FROM w GROUP BY 1"""
)
def longest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of each document; of equals the last."""
    return read_table(spark, sf_dir, "documents").select("doc_id", enrichment.longest_word(F.split("text", r"\s+")).alias("word"))


@register("SELECT p_partkey, split_part(p_type, ' ', 1) AS root, CASE WHEN p_partkey % 3 = 0 THEN false ELSE split_part(p_type, ' ', 1) <> p_brand END AS changed FROM part")
def breadcrumb_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.replace(F.col("p_type"), F.lit(" "), F.lit(" > "))
    before = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select("p_partkey", T.breadcrumb_root(path).alias("root"), T.root_changes(before, path).alias("changed"))


@register("SELECT r.r_regionkey, string_agg('name: ' || n.n_name || ' | key: ' || n.n_nationkey, chr(10) ORDER BY n.n_nationkey) AS dump FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def region_cell_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as a markdown table, flattened to cells."""
    line = F.concat(F.lit("| "), "n_name", F.lit(" |  | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    rows = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    return rows.select("r_regionkey", extraction.cell_dump(F.concat(F.lit("| name | empty | key |\n|---|:-:|---|\n"), "body")).alias("dump"))


@register("SELECT c_custkey, '[REDACTED_NAME]' || substring(c_name, 9, 3) || '[REDACTED_ID]' AS masked FROM customer")
def redacted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda s, e, t: F.struct(s.alias("start"), e.alias("end"), F.lit(t).alias("type"))
    spans = F.array(span(F.lit(0), F.lit(8), "NAME"), span(F.lit(11), F.length("c_name"), "ID"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", enrichment.redact_spans(F.col("c_name"), spans).alias("masked"))


@register("SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1' AND (p_size IN (11, 12, 13) OR p_retailprice >= 1000)")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"p_size": {"$gt": 10}, "p_brand": {"$ne": "Brand#1"}, "$or": [{"p_size": {"$in": [11, 12, 13]}}, {"p_retailprice": {"$gte": 1000}}]}
    return read_table(spark, sf_dir, "part").where(store.metadata_filter(wanted)).select("p_partkey")


@register("SELECT 'user:' || user_id AS namespace, CAST(event_id AS VARCHAR) AS key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def latest_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id").alias("namespace"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("ts"))
    return store.latest_episodes(rows).select("namespace", "key")


@register(
    """WITH e AS (SELECT 'u' || user_id AS namespace, event_type AS key, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events)
    SELECT namespace, key, event_id AS ts FROM e WHERE r = 1 AND event_id % 7 <> 0"""
)
def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after all puts in order; a last put of null deletes."""
    k = F.col("event_id")
    value = F.when(k % 7 != 0, F.create_map(F.lit("value"), F.col("value").cast("string")))
    rows = read_table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("namespace"), F.col("event_type").alias("key"), value.alias("value"), k.alias("ts"), F.lit(None).cast("array<double>").alias("embedding"))
    return store.put(rows.limit(0), rows).select("namespace", "key", "ts")


@register(
    """SELECT conv_id, turn, turn % 3 = 0 AS store, CASE WHEN turn % 3 = 2 THEN text ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations WHERE role = 'assistant'"""
)
def episodic_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("turn") % 3 == 0, "\nEPISODIC: YES").when(F.col("turn") % 3 == 1, "\nEPISODIC: no").otherwise("")
    said = read_table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", enrichment.episodic_decision(F.concat("text", tag)).alias("d"))
    return said.select("conv_id", "turn", "d.store", "d.answer")


@register(
    """SELECT 'p' || p_size || '_' || lower(replace(p_brand, '#', '')) || '_' || row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS id, p_partkey FROM part"""
)
def unique_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "part").select(F.lit(1).alias("doc_id"), F.col("p_size").alias("page"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))).alias("type"), F.col("p_partkey").alias("seq"))
    return extraction.unique_ids(items.withColumn("doc_id", F.col("page"))).select("id", F.col("seq").alias("p_partkey"))


@register(
    """SELECT n_nationkey, '<!-- BOUNDARY_START type="nation" id="n' || n_nationkey || '" page="' || n_regionkey || '" breadcrumbs="A &gt; &quot;B&quot;" -->' || chr(10) || n_name || chr(10) || '<!-- BOUNDARY_END type="nation" id="n' || n_nationkey || '" -->' AS t FROM nation"""
)
def boundary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    mark = T.wrap_with_boundaries(F.lit("nation"), ident, F.col("n_regionkey"), F.col("n_name"), {"breadcrumbs": F.lit('A > "B"'), "missing": F.lit(None).cast("string")})
    return read_table(spark, sf_dir, "nation").select("n_nationkey", mark.alias("t"))


@register("SELECT role, count(*) AS messages, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, round(sum(greatest(1, length(text) // 4)) / 1000000.0 * 20, 4)::DOUBLE AS cost FROM conversations WHERE role <> 'system' GROUP BY 1")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(T.token_estimate(F.col("text")))
    return read_table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("role").agg(F.count("*").alias("messages"), tokens.alias("tokens"), F.round(tokens / 1e6 * 20, 4).alias("cost"))


@register("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS size, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", search.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(search.norm(F.col("u")), 6).alias("size"), F.size("u").alias("dims"))


@register(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 'skip' WHEN l_discount * 10 < 0.5 THEN 'blocked_consistency' WHEN least(0.9, l_discount * 10) < 0.75 THEN 'disclaimer' ELSE 'pass' END AS verdict FROM lineitem"""
)
def output_guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.operators.evaluation import output_guard  # noqa: PLC0415

    answer = F.when(F.col("l_quantity") < 3, "__sentinel__").otherwise("text")
    verdict = output_guard(answer, F.lit(0.9), F.col("l_discount") * 10, F.lit(None).cast("string"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", verdict.alias("verdict"))
