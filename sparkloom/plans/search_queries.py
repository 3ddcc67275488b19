"""Vector search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, search
from sparkloom.plans.registry import register
from sparkloom.session import read_table

PROBE = 17  # the vector that single searches ask for
_SIM = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).where(F.col("vec_id") == PROBE).first()["embedding"])


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


@register(f"SELECT v.vec_id, v.label, round({_SIM}, 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} ORDER BY {_SIM} DESC, v.vec_id LIMIT 10")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10).select("vec_id", "label", F.round("score", 5).alias("score"))


@register(f"SELECT v.vec_id, round({_SIM}, 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} AND v.label IN (1, 2, 3) AND {_SIM} >= 0.1 ORDER BY {_SIM} DESC, v.vec_id LIMIT 25")
def vector_threshold_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 25, at_least=0.1, where=F.col("label").isin(1, 2, 3))
    return found.select("vec_id", F.round("score", 5).alias("score"))


@register(f"SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id LIMIT 10")
def vector_top_k_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, "euclidean").select("vec_id", F.round("score", 5).alias("score"))


@register(f"SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 10")
def vector_top_k_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, "dotproduct").select("vec_id", F.round("score", 5).alias("score"))


@register(
    f"""(SELECT 'semantic' AS memory, v.vec_id, round({_SIM}, 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} AND v.label < 5 ORDER BY {_SIM} DESC, v.vec_id LIMIT 8)
    UNION ALL (SELECT 'procedural', v.vec_id, round({_SIM}, 5) FROM embeddings v, embeddings q WHERE q.vec_id = {PROBE} AND v.label >= 5 ORDER BY {_SIM} DESC, v.vec_id LIMIT 3)"""
)
def two_memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = search.two_memories(vectors.where("label < 5"), vectors.where("label >= 5"), _query(spark, sf_dir))
    return found.select("memory", "vec_id", F.round("score", 5).alias("score"))


@register(
    f"""SELECT query_id, vec_id, round(s, 5) AS score, CAST(r AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, v.vec_id) AS r
    FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE r <= 10"""
)
def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return search.search_all(_asked(vectors), vectors, 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@register(f"SELECT q.vec_id AS query_id, v.vec_id, round({_SIM}, 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND {_SIM} >= 0.3")
def vector_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return search.search_all(_asked(vectors), vectors, 0, 0.3).where("query_id <> vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"))


@register()
def vector_search_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted-file index over every row; as many lists are probed as the recall asks for."""
    vectors = _vectors(spark, sf_dir)
    centres = search.fit_centroids(vectors, 16)
    return search.search_index(_asked(vectors), search.with_lists(vectors, centres), centres, 10, search.fit_probes(vectors, centres))


@register(f"WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, v.vec_id) AS r FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) SELECT count(*) AS wanted, true AS reached FROM r WHERE r <= 10")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index finds of all that the exact search finds: nine of ten at least."""
    vectors = _vectors(spark, sf_dir)
    exact = search.search_all(_asked(vectors), vectors, 10).select("query_id", "vec_id")
    found = vector_search_ivf(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@register("SELECT label, i AS dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, CAST(generate_subscripts(embedding, 1) AS INT) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@register("SELECT CAST(len(embedding) AS INT) AS dims, count(*) AS n, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS least_norm FROM embeddings GROUP BY 1")
def load_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.round(F.min(search.norm(F.col("embedding"))), 4).alias("least_norm"))


_RANKED = f"""r AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id, v.label AS vl, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, v.vec_id) AS r FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
    n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    h AS (SELECT query_id, any_value(ql) AS ql, sum(CASE WHEN ql = vl THEN 1 ELSE 0 END)::DOUBLE AS hits, sum(CASE WHEN ql = vl THEN 1 / log2(r + 1) ELSE 0 END) AS dcg FROM r WHERE r <= 10 GROUP BY 1),
    m AS (SELECT query_id, hits / 10 AS p, hits / (n - 1) AS rc, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n - 1, 10)) AS ndcg FROM h JOIN n ON label = ql)"""


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = search.search_all(_asked(vectors), vectors, 11).where("query_id <> vec_id")
    labels = vectors.select("vec_id", "label")
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    judged = found.join(labels, "vec_id").join(_asked(vectors).select("query_id", "query_label"), "query_id")
    hits = judged.groupBy("query_id", "query_label").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.col("label") == F.col("query_label")).alias("hit")))), lambda s: s["hit"]), 1, 10).alias("hits"))
    asked = hits.join(sizes, F.col("query_label") == F.col("label"))
    return asked.select("query_id", evaluation.ranked_metrics(F.col("hits"), F.col("relevant"), 10).alias("m")).select("query_id", "m.*")


@register(f"WITH {_RANKED} SELECT query_id, round(p, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 4) AS f1, hit::DOUBLE AS hit_rate, round(ndcg, 4) AS ndcg FROM m")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieval(spark, sf_dir)


@register(f"WITH {_RANKED} SELECT round(avg(round(p, 4)), 4) AS precision, round(avg(round(rc, 4)), 4) AS recall, round(avg(hit), 4)::DOUBLE AS hit_rate FROM m")
def retrieval_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averages(_retrieval(spark, sf_dir), ["precision", "recall", "hit_rate"])


_PAIRS = "(SELECT a.conv_id, a.turn, a.text AS answer, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read_table(spark, sf_dir, "conversations")
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return talk.select("conv_id", "turn", F.col("text").alias("answer")).join(after, ["conv_id", "turn"]).withColumn("key", F.concat_ws("-", "conv_id", "turn"))


@register(
    f"""WITH p AS (SELECT conv_id || '-' || turn AS key, regexp_replace(lower(answer), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS a, regexp_replace(lower(reference), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS r FROM {_PAIRS}),
    w AS (SELECT key, unnest(regexp_split_to_array(a, '\\s+')) AS w, 1 AS a, 0 AS r FROM p UNION ALL SELECT key, unnest(regexp_split_to_array(r, '\\s+')), 0, 1 FROM p),
    c AS (SELECT key, w, sum(a) AS a, sum(r) AS r FROM w WHERE w <> '' GROUP BY 1, 2), s AS (SELECT key, sum(least(a, r))::DOUBLE AS same, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM c GROUP BY 1)
    SELECT p.key, coalesce(CASE WHEN same > 0 THEN round(2 * (same / s.a) * (same / s.r) / (same / s.a + same / s.r), 4) ELSE 0.0 END, 0.0)::DOUBLE AS token_f1 FROM p LEFT JOIN s ON s.key = p.key"""
)
def token_f1_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.token_f1(_pairs(spark, sf_dir), "key", "answer", "reference")


@register(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a * b + b * c + a * c = 0 THEN 0.0 ELSE 3 * a * b * c / (a * b + b * c + a * c) END, 6) AS triad FROM t"""
)
def rag_triad_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    triad = evaluation.rag_triad(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(triad, 6).alias("triad"))


@register(
    f"""SELECT left(md5('faq' || q.text), 16) AS key, CAST(length(left(a.text, 8000)) AS INT) AS n FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' AND 3600 + q.turn * 60 > 3600 + 90"""
)
def semantic_cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows of answered questions that are unexpired at the moment asked for."""
    talk = read_table(spark, sf_dir, "conversations")
    after = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = talk.where("role = 'user'").join(after, ["conv_id", "turn"]).select(F.lit("faq").alias("namespace"), F.col("text").alias("question"), "answer", "turn")
    stamped = rows.select(search.cache_key(F.col("namespace"), F.col("question")).alias("key"), F.length(F.left("answer", F.lit(8000))).alias("n"), (F.lit(3600) + F.col("turn") * 60).alias("expires_at"))
    return stamped.where(F.col("expires_at") > 3600 + 90).drop("expires_at")
