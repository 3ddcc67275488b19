"""A keyed store of values under namespaces, with recall by vector or by time, and filters written as nested objects."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.mutations import keep_last
from sparkloom.operators.search import top_k

SCHEMA = "namespace string, key string, value map<string,string>, ts long, embedding array<double>"

_TESTS = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~c.isin(v)}


def metadata_filter(wanted: dict, column=F.col) -> Column:
    """{"a": 1, "b": {"$gt": 2}, "$or": [..]} as a predicate that is pushed below the ranking."""
    parts = []
    for field, test in wanted.items():
        if field in ("$and", "$or"):
            many = [metadata_filter(t, column) for t in test]
            joined = many[0]
            for m in many[1:]:
                joined = (joined & m) if field == "$and" else (joined | m)
            parts.append(joined)
        elif isinstance(test, dict):
            parts += [_TESTS[op](column(field), F.lit(v) if not isinstance(v, list) else v) for op, v in test.items()]
        else:
            parts.append(column(field) == test)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def put(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Later changes win by ts; a null value deletes the key."""
    both = store.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return keep_last(both, ["namespace", "key"], F.col("__new"), F.col("ts")).drop("__new").where("value is not null")


def get(store: DataFrame, namespace: str, key: str) -> DataFrame:
    return store.where((F.col("namespace") == namespace) & (F.col("key") == key))


def search(store: DataFrame, prefix: str, query: list[float] | None, limit: int = 10, offset: int = 0, where: dict | None = None) -> DataFrame:
    """Entries of a namespace or below it: nearest first, or without a query the newest first. Filtered before ranking, so the
    answer is exact."""
    rows = store.where((F.col("namespace") == prefix) | F.col("namespace").startswith(prefix + ":"))
    if where:
        rows = rows.where(metadata_filter(where, lambda f: F.col("value")[f]))
    if query is None:
        return rows.orderBy(F.desc("ts"), "namespace", "key").offset(offset).limit(limit).withColumn("score", F.lit(None).cast("double"))
    return top_k(rows, query, limit + offset, id_column="key").offset(offset)


def namespaces(store: DataFrame, depth: int | None = None) -> DataFrame:
    name = F.col("namespace") if depth is None else F.array_join(F.slice(F.split("namespace", ":"), 1, depth), ":")
    return store.select(name.alias("namespace")).distinct()


def latest_episodes(store: DataFrame, most: int = 3) -> DataFrame:
    newest = Window.partitionBy("namespace").orderBy(F.desc("ts"), "key")
    return store.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)


def episode_key(user: Column, question: Column) -> Column:
    return F.left(F.md5(F.concat(user, question)), F.lit(12))


def stand_in_vector(text: str, dimensions: int = 1536) -> list[float]:
    """A unit vector that depends on the text only; far from any real embedding."""
    source = random.Random(int(hashlib.md5(text.encode()).hexdigest()[:8], 16))
    values = [source.gauss(0, 1) for _ in range(dimensions)]
    size = sum(v * v for v in values) ** 0.5 + 1e-9
    return [v / size for v in values]


def stand_in_embedding(text: Column, dimensions: int = 1536) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: stand_in_vector(t or "", dimensions)), "array<double>")(text)


def table_columns(spark: SparkSession, table: str) -> DataFrame:
    """What the catalog knows of a table: name, type, whether nulls are allowed."""
    return spark.createDataFrame([(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)], "name string, type string, nullable boolean")


def golden_and_corpus(examples: DataFrame, golden: int = 30, corpus: int = 500) -> tuple[DataFrame, DataFrame]:
    """examples(id, question, answer, contexts): the first ``golden`` by id as questions with context ids {id}_d{k}, and the
    contexts of the first ``corpus`` as rows that say whether they belong to a golden one. Texts are cut at 8000 characters."""
    ranked = examples.orderBy("id").limit(corpus)
    first = examples.orderBy("id").limit(golden)
    ids = F.transform("contexts", lambda c, k: F.format_string("%s_d%d", F.col("id"), k))
    questions = first.select("id", F.col("question").alias("input"), F.left("answer", F.lit(2000)).alias("reference"), F.transform("contexts", lambda c: F.left(c, F.lit(8000))).alias("contexts"), ids.alias("context_ids"))
    pieces = ranked.select("id", F.posexplode("contexts").alias("k", "c")).join(first.select("id", F.lit(True).alias("g")), "id", "left")
    return questions, pieces.select(F.format_string("%s_d%d", "id", "k").alias("id"), F.left("c", F.lit(8000)).alias("text"), F.coalesce("g", F.lit(False)).alias("in_golden"))


# Under which names a context's text may stand, the first that is there counts.
TEXT_KEYS = ("text", "content", "page_content", "body")


def plain_contexts(documents: Column, sentences: Column) -> Column:
    """The contexts of an example as texts, whatever shape its JSON has: texts; lists of sentences, which are joined; objects with a
    text under one of TEXT_KEYS, or with a list ``sentences``. Where that gives none, or the first item is of no such kind,
    the lists of sentences beside it count. What is no list, or an empty one, gives none."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_a = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))
    blank = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "") == ""
    none = F.array().cast("array<string>")
    items = get(F.try_parse_json(documents), "$", "array<variant>")
    text = lambda v: F.when(is_a(v, "STRING"), get(v, "$", "string"))
    some = lambda v: F.when(~blank(text(v)), text(v))
    joined = lambda v: F.when(is_a(v, "ARRAY"), F.array_join(F.array_compact(F.transform(get(v, "$", "array<variant>"), some)), " "))
    named = lambda v: F.coalesce(*[F.regexp_replace(some(get(v, f"$.{k}", "variant")), r"^\s+|\s+$", "") for k in TEXT_KEYS])
    of_object = lambda v: F.when(is_a(v, "OBJECT"), F.nullif(F.coalesce(named(v), joined(get(v, "$.sentences", "variant"))), F.lit("")))
    each = lambda f: F.array_compact(F.transform(items, f))
    last = F.coalesce(F.array_compact(F.transform(get(F.try_parse_json(sentences), "$", "array<variant>"), joined)), none)
    first = F.get(items, F.lit(0))
    objects = each(of_object)
    return F.when(items.isNull() | (F.size(items) == 0), none).when(is_a(first, "STRING"), each(some)).when(is_a(first, "ARRAY"), each(joined)).when(is_a(first, "OBJECT") & (F.size(objects) > 0), objects).otherwise(last)
