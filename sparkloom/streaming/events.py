"""Structured Streaming over the event table: windows, sessions and deduplication with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.mutations import keep_last
from sparkloom.session import temporary_path
from sparkloom.streaming.replay import drained


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The events as a stream. The time is made a TIMESTAMP (in the session's zone), as watermarks need one."""
    at = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(at).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(_folder_glob(spark, at))
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def _folder_glob(spark: SparkSession, path: str) -> str:
    """A stream reads folders or globs: a single file is named by a glob that only it meets."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return path if found.isDirectory() else path[:-1] + "[" + path[-1] + "]"


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over all there is. Each batch is written with its number, so a batch that is repeated after a failure
    overwrites itself; the last state of each key counts."""
    spark = stream.sparkSession
    root = temporary_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "long")
    rows = spark.read.schema(schema).parquet(f"{root}/data")
    return keep_last(rows, keys, F.col("batch")).drop("batch") if keys else rows.drop("batch")


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "n")


def first_of_each(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Runs of a user's events without a gap of more than ``gap_seconds``: by gaps and islands, partitioned by user."""
    order = Window.partitionBy("user_id").orderBy("second", "event_id")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    marked = events.withColumn("second", second).withColumn("new", F.coalesce((F.col("second") - F.lag("second").over(order) > gap_seconds).cast("int"), F.lit(1)))
    return marked.withColumn("session", F.sum("new").over(order)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("second").alias("begin"), F.max("second").alias("end"))


def session_stream(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """The same as a stream: session windows that close when the watermark has passed them."""
    counts = stream.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.unix_timestamp("w.start").alias("begin"), "n")


#: Late rows of a batch are judged by the watermark that the batch before it began with: rows of the last batch but one and
#: of those before it have moved it.
LAG = 2


def closed_windows(stream: DataFrame, path: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type in append mode: a window comes once, when the watermark has passed its end, and
    rows behind the watermark don't count."""
    counts = stream.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    rows = counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    drained(rows, f"{path}/windows-state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/windows/batch={n}"))
    return stream.sparkSession.read.schema(rows.schema).parquet(f"{path}/windows/batch=*")


def late_rows(stream: DataFrame, path: str, width_seconds: int = 86_400, delay_seconds: int = 3_600) -> DataFrame:
    """The rows that closed_windows() leaves out as late, all columns: a side table, written by batch beside each batch's
    largest time, of which the watermark of later batches is made."""
    spark = stream.sparkSession
    marks = "batch_number long, most long"

    def put(batch: DataFrame, n: int) -> None:
        passed = None
        if n >= LAG:
            known = spark.read.schema(marks).parquet(f"{path}/marks/batch=*").where(F.col("batch_number") <= n - LAG)
            passed = known.agg(F.max("most")).first()[0]
        end = (F.floor(F.unix_millis("at") / (width_seconds * 1000)) + 1) * (width_seconds * 1000)
        late = F.lit(False) if passed is None else end <= passed - delay_seconds * 1000
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={n}")
        batch.agg(F.lit(n).cast("long").alias("batch_number"), F.max(F.unix_millis("at")).alias("most")).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")

    drained(stream, f"{path}/late-state", put)
    return spark.read.schema(stream.schema).parquet(f"{path}/late/batch=*")
