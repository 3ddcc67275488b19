"""Upload validation, change streams and event windows; each stream's final state is what the batch SQL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import register
from sparkloom.session import read_table, temporary_path
from sparkloom.streaming import cdc, documents, events, outbox, polling, replay, series

_UPLOADS = """(SELECT 'UPLOAD_' || (p_partkey % 25) AS upload_id, 'VEND' || (p_partkey % 5) AS vendor_id, p_partkey AS row_number, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS product_name, p_brand AS category,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'SKU' || (p_partkey // 2 * 2) END AS sku, CASE WHEN p_partkey % 11 = 0 THEN -1.0 WHEN p_partkey % 19 = 0 THEN 0.0 ELSE p_retailprice END AS price,
    CASE WHEN p_partkey % 23 = 0 THEN -5 ELSE p_size END AS stock_quantity FROM part)"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product uploads made of parts, with faults in them. Neighbours share a SKU, but not an upload."""
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("UPLOAD_"), k % 25).alias("upload_id"), F.concat(F.lit("VEND"), k % 5).alias("vendor_id"), F.format_string("REC_%05d", k).alias("record_id"), k.alias("row_number"),
        F.concat(F.lit("VP"), k).alias("vendor_product_id"), F.when(k % 13 != 0, F.col("p_name")).alias("product_name"), F.col("p_brand").alias("category"), F.lit("").alias("description"), F.col("p_brand").alias("brand"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("SKU"), (F.floor(k / 2) * 2).cast("string"))).alias("sku"),
        F.when(k % 11 == 0, -1.0).when(k % 19 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.when(k % 23 == 0, -5).otherwise(F.col("p_size")).alias("stock_quantity"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    categories = part.select(F.col("p_brand").alias("category_name"), (F.col("p_brand") != "Brand#1").alias("is_active")).distinct()
    taken = part.where("p_partkey % 29 = 0").select(F.concat(F.lit("SKU"), (F.floor(F.col("p_partkey") / 2) * 2).cast("string")).alias("sku"), F.lit("none").alias("vendor_id"), F.lit("none").alias("vendor_product_id"))
    return cdc.validated(_uploads(spark, sf_dir), categories, taken)


_JUDGED = f"""(WITH u AS (SELECT * FROM {_UPLOADS}), taken AS (SELECT DISTINCT 'SKU' || (p_partkey // 2 * 2) AS sku FROM part WHERE p_partkey % 29 = 0)
    SELECT upload_id, vendor_id, row_number, CASE WHEN coalesce(product_name, '') = '' OR sku = '' OR price = 0 OR stock_quantity = 0 THEN 'MISSING_REQUIRED_FIELDS' WHEN price < 0.01 THEN 'INVALID_PRICE' WHEN stock_quantity < 0 THEN 'INVALID_STOCK'
    WHEN category = 'Brand#1' THEN 'INVALID_CATEGORY' WHEN sku IN (SELECT sku FROM taken) THEN 'DUPLICATE_SKU' END AS error_type FROM u)"""


@register(f"SELECT upload_id, vendor_id, row_number, CASE WHEN error_type IS NULL THEN 'validated' ELSE 'error' END AS status, error_type FROM {_JUDGED}")
def validated_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("upload_id", "vendor_id", "row_number", "status", "error_type")


@register(f"SELECT upload_id, count(*) AS total_records, sum(CASE WHEN error_type IS NULL THEN 1 ELSE 0 END)::BIGINT AS valid_records, sum(CASE WHEN error_type IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS error_records, CASE WHEN sum(CASE WHEN error_type IS NOT NULL THEN 1 ELSE 0 END) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status FROM {_JUDGED} GROUP BY 1")
def upload_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _uploads(spark, sf_dir).groupBy("upload_id").agg(F.count("*").alias("total_records"))
    return cdc.upload_summary(_judged(spark, sf_dir), history).select("upload_id", "total_records", "valid_records", "error_records", "status")


@register(f"SELECT upload_id, count(*) AS n, min(row_number) AS first_row FROM {_JUDGED} WHERE error_type IS NOT NULL GROUP BY 1")
def errors_by_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cdc.grouped_errors(_judged(spark, sf_dir).where("status = 'error'"))
    return found.select("upload_id", F.size("errors").cast("long").alias("n"), F.element_at("errors", 1)["row_number"].alias("first_row"))


@register(
    """WITH e AS (SELECT *, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CASE WHEN t0 <> event_type THEN 'event_type' END AS changed FROM e WHERE t0 IS NOT NULL"""
)
def change_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference between a user's consecutive events, as old and new images of two fields of which one is not compared."""
    from pyspark.sql import Window  # noqa: PLC0415

    order = Window.partitionBy("user_id").orderBy("event_id")
    image = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    rows = read_table(spark, sf_dir, "events").select("event_id", image.alias("new"), F.lag(image).over(order).alias("old")).where("old is not null")
    return rows.select("event_id", F.get(F.map_keys(cdc.changes(F.col("old"), F.col("new"))), F.lit(0)).alias("changed"))


@register("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6)))::DOUBLE AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = events.run_to_table(events.tumbling(events.event_stream(spark, sf_dir)), ["window_start", "event_type"])
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("SELECT s + INTERVAL 6 HOUR * k AS window_start, count(*) AS n FROM (SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS TIMESTAMP) - INTERVAL 18 HOUR AS s FROM events), range(0, 4) r(k) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = events.run_to_table(events.sliding(events.event_stream(spark, sf_dir)), ["window_start"])
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = events.first_of_each(events.event_stream(spark, sf_dir), ["event_id"]).select("event_id")
    return events.run_to_table(once, [], "append")


@register(
    """WITH o AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events), m AS (SELECT *, CASE WHEN s - lag(s) OVER w > 3600 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS session FROM m) SELECT user_id, session, count(*) AS n, min(s) AS begin, max(s) AS "end" FROM g GROUP BY 1, 2"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts"))


# Streams of several batches: the event table in slices.

SLICES, TTL = 4, 5 * 86_400
_SLICED = f"(SELECT *, event_id * {SLICES} // (SELECT max(event_id) + 1 FROM events) AS slice FROM events)"
_DELAYED = f"(SELECT *, CASE WHEN event_id % 17 = 0 THEN {SLICES - 1} ELSE slice END AS comes FROM {_SLICED})"


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the number of the batch they come in."""
    rows = read_table(spark, sf_dir, "events")
    size = rows.agg(F.max("event_id") + 1).first()[0] or 1
    return rows.withColumns({"at": F.col("ts").cast("timestamp"), "slice": F.floor(F.col("event_id") * SLICES / F.lit(size)).cast("int")})


def _delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but every seventeenth event comes in the last batch."""
    return _sliced(spark, sf_dir).withColumn("slice", F.when(F.col("event_id") % 17 == 0, SLICES - 1).otherwise(F.col("slice")))


_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'stage' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'retry' END END"


def _next_state() -> str:
    """One change in SQL: a (so far: s state, r retries, l last change, n changes), e (k kind, t time)."""
    was = f"CASE WHEN a.s <> 'NONE' AND e.t - a.l > {TTL * 1_000_000} THEN 'NONE' ELSE a.s END"
    tries = f"CASE WHEN a.s <> 'NONE' AND e.t - a.l > {TTL * 1_000_000} THEN 0 ELSE a.r END"
    ok = f"CASE e.k WHEN 'created' THEN {was} = 'NONE' WHEN 'claimed' THEN {was} = 'PENDING' WHEN 'retry' THEN {was} = 'FAILED' AND {tries} < {documents.MOST_RETRIES} ELSE {was} = 'IN_PROGRESS' END"
    after = "CASE e.k WHEN 'created' THEN 'PENDING' WHEN 'claimed' THEN 'IN_PROGRESS' WHEN 'stage' THEN 'IN_PROGRESS' WHEN 'completed' THEN 'COMPLETED' WHEN 'failed' THEN 'FAILED' ELSE 'PENDING' END"
    return f"""{{'k': '', 't': 0::BIGINT, 's': CASE WHEN {ok} THEN {after} ELSE {was} END, 'r': CASE WHEN {ok} AND e.k = 'retry' THEN {tries} + 1 ELSE {tries} END,
        'l': CASE WHEN {ok} THEN e.t ELSE a.l END, 'n': CASE WHEN {ok} THEN a.n + 1 ELSE a.n END}}"""


_LIVES = f"""(SELECT user_id, list_reduce(list_concat([{{'k': '', 't': 0::BIGINT, 's': 'NONE', 'r': 0::BIGINT, 'l': 0::BIGINT, 'n': 0::BIGINT}}], list(x ORDER BY x.t, id)), lambda a, e: {_next_state()}) AS z
    FROM (SELECT user_id, event_id AS id, {{'k': {_KIND}, 't': epoch_us(ts), 's': 'NONE', 'r': 0::BIGINT, 'l': 0::BIGINT, 'n': 0::BIGINT}} AS x FROM events) GROUP BY user_id)"""


@register(
    f"""SELECT CAST(user_id AS VARCHAR) AS document_id, z.s AS status, CAST(z.r AS INT) AS retries, z.n AS changes FROM {_LIVES}
    WHERE z.s <> 'NONE' AND (SELECT epoch_us(max(ts)) FROM events) - z.l <= {TTL * 1_000_000}"""
)
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states in which a stream of changes leaves its documents: one a user, whose events are the changes."""
    rows, path = _sliced(spark, sf_dir), temporary_path(spark, "documents")
    kind = F.expr(_KIND)
    changes = rows.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("change_id"), kind.alias("change"), F.when(kind == "stage", F.col("event_id").cast("string")).alias("stage"), "at", "slice")
    documents.run(replay.sliced_stream(changes, "slice", SLICES), path, TTL)
    now = rows.agg(F.max("at")).first()[0]
    return documents.states(documents.audit_table(spark, path), now, TTL).select("document_id", "status", "retries", "changes")


_CONTROL = "(SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS status, o_orderdate AS updated_at FROM orders)"


@register(f"SELECT document_id, (r - 1) // 10 AS poll FROM (SELECT document_id, row_number() OVER (ORDER BY updated_at, document_id) AS r FROM {_CONTROL} WHERE status = 'PENDING') WHERE r <= 40")
def polled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four polls over the open orders as documents: ten claims each, the oldest first; the limit is the feature."""
    orders = read_table(spark, sf_dir, "orders")
    control = orders.select(F.col("o_orderkey").cast("string").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("COMPLETED").alias("status"), F.col("o_orderdate").alias("updated_at"))
    polls = polling.Polls(spark, temporary_path(spark, "polls"), lambda: control, "one")
    polls.run(lambda claimed, n: None, 4, interval=0.05)
    return polls.claims().select("document_id", "poll")


@register(
    f"""SELECT slice AS batch, unnest(['rows', 'errors', 'total']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (event_type = 'error')::DOUBLE, sum(CAST(value AS DECIMAL(18,6)))::DOUBLE]) AS value FROM {_SLICED} GROUP BY slice"""
)
def step_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a step of a stream counts of each batch, read back from the table that a listener appends to."""
    stream = replay.sliced_stream(_sliced(spark, sf_dir), "slice", SLICES)
    counted = series.observed(stream, "read", rows=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"), total=F.sum(F.col("value").cast("decimal(18,6)")))
    with series.Series(spark, temporary_path(spark, "series")) as gathered:
        replay.drained(counted, temporary_path(spark, "series-state"), lambda batch, n: batch.write.format("noop").mode("overwrite").save())
    return gathered.table().where("step = 'read'").select("batch", "metric", "value")


#: A row is late if its day has ended an hour before the largest time of the batches up to the last but one.
_MARKS = f"(SELECT comes, max(epoch_ms(ts)) AS most FROM {_DELAYED} GROUP BY 1)"
_JUDGED_LATE = f"""(SELECT d.*, epoch_ms(date_trunc('day', ts)) + 86400000 <= coalesce((SELECT max(most) FROM {_MARKS} m WHERE m.comes <= d.comes - 2), 0) - 3600000 AS late FROM {_DELAYED} d)"""


@register(f"SELECT event_id, user_id, CAST(comes AS INT) AS slice FROM {_JUDGED_LATE} WHERE late")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come behind the watermark."""
    stream = replay.sliced_stream(_delayed(spark, sf_dir), "slice", SLICES)
    return events.late_rows(stream, temporary_path(spark, "late")).select("event_id", "user_id", "slice")


@register(
    f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6)))::DOUBLE AS total FROM {_JUDGED_LATE}
    WHERE NOT late AND epoch_ms(date_trunc('day', ts)) + 86400000 <= (SELECT max(most) FROM {_MARKS}) - 3600000 GROUP BY 1, 2"""
)
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in append mode: only those that the watermark has passed, without the rows that came behind it."""
    stream = replay.sliced_stream(_delayed(spark, sf_dir), "slice", SLICES)
    done = events.closed_windows(stream, temporary_path(spark, "windows"))
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register(
    f"""SELECT 'error' AS kind, CAST(event_id AS VARCHAR) AS key, '{{"user":' || user_id || ',"event":' || event_id || '}}' AS body, slice AS batch FROM {_SLICED} WHERE event_type = 'error'
    UNION ALL SELECT 'metric', 'events', '{{"n":' || count(*) || '}}', slice FROM {_SLICED} GROUP BY slice"""
)
def outbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each error and a metric for each batch of the event stream, each there once."""
    out = outbox.Outbox(spark, temporary_path(spark, "outbox"))

    def put(batch: DataFrame, n: int) -> None:
        errors = batch.where("event_type = 'error'").select(*outbox.message("error", F.col("event_id"), F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("event"))))
        metric = batch.agg(F.count("*").alias("n")).select(*outbox.message("metric", F.lit("events"), F.struct("n")))
        out.put(errors.unionByName(metric), n)

    replay.drained(replay.sliced_stream(_sliced(spark, sf_dir), "slice", SLICES), temporary_path(spark, "outbox-state"), put)
    return out.messages().select("kind", "key", "body", "batch")
