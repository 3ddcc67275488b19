"""Writers: JSON, partitioned tables, vector stores, status tables. Each write is one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.mutations import upsert
from sparkloom.operators.search import check_dimensions
from sparkloom.session import spread
from sparkloom.sources.folders import file_system

STAGES = ("extract", "chunk", "enrich", "embed", "load")


def write_json(rows: DataFrame, path: str) -> None:
    """UTF-8, one object a line; letters stay letters."""
    rows.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def write_without_reasoning(rows: DataFrame, path: str) -> None:
    write_json(rows.drop(*[c for c in rows.columns if "reasoning" in c]), path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Replaces a vector table, partitioned by namespace; vectors of different dimensions are refused."""
    check_dimensions(rows)
    rows.write.mode("overwrite").partitionBy("namespace").parquet(path)


def upsert_vectors(table: DataFrame, rows: DataFrame, path: str) -> None:
    """Writes table with rows put in by id, to another path than table's; the last of several rows with an id wins."""
    upsert(table, rows, ["namespace", "id"], F.col("created_at")).write.mode("overwrite").partitionBy("namespace").parquet(path)


def load_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.min(F.left("content", F.lit(80))).alias("sample"))


def embedding_summary(rows: DataFrame, price_per_million: float) -> DataFrame:
    """One row about an embedding run: counts and cost."""
    done = F.col("embedding").isNotNull()
    tokens = F.sum(F.when(done, F.greatest(F.lit(1), F.floor(F.length("content") / 4))).otherwise(0))
    return rows.agg(F.count("*").alias("total"), F.count_if(done).alias("embedded"), F.count_if(~done).alias("skipped"), tokens.alias("tokens"), F.round(tokens / 1e6 * price_per_million, 4).alias("cost"))


def with_skips(rows: DataFrame) -> DataFrame:
    """Blank contents and placeholders lose their vector and say why."""
    why = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty content").when(F.col("content").startswith("AI description unavailable"), "placeholder")
    return rows.withColumns({"skipped_reason": why, "skipped": why.isNotNull(), "embedding": F.when(why.isNull(), F.col("embedding"))})


def control_rows(documents: DataFrame, now: Column, version: str = "v1") -> DataFrame:
    """Control records of new documents: PENDING in all stages, no retries, for 90 days."""
    states = F.create_map(*[x for s in STAGES for x in (F.lit(s), F.lit("PENDING"))])
    return documents.select("document_id", F.lit(version).alias("processing_version"), F.lit("PENDING").alias("status"), states.alias("stage_status"), F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), now.alias("updated_at"), (now + 90 * 86400).alias("ttl"))


def with_stage(control: DataFrame, stage: str, status: str, which: Column, now: Column) -> DataFrame:
    """Sets one stage's state; a failed stage fails the document, the last completed one completes it."""
    new = F.map_concat(F.map_filter("stage_status", lambda k, v: k != stage), F.create_map(F.lit(stage), F.lit(status)))
    overall = "FAILED" if status == "FAILED" else "COMPLETED" if status == "COMPLETED" and stage == STAGES[-1] else "IN_PROGRESS"
    return control.withColumns({"stage_status": F.when(which, new).otherwise(F.col("stage_status")), "status": F.when(which, overall).otherwise(F.col("status")), "updated_at": F.when(which, now).otherwise(F.col("updated_at"))})


def audit_rows(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """One audit row for each status that changed, for 180 days."""
    old = before.select("document_id", F.col("status").alias("old_status"))
    joined = after.join(old, "document_id", "left").where(~F.col("status").eqNullSafe(F.col("old_status")))
    return joined.select("document_id", now.alias("timestamp"), "old_status", F.col("status").alias("new_status"), (now + 180 * 86400).alias("ttl"))


def audit_trail(audit: DataFrame, document_id: str) -> DataFrame:
    """A document's audit rows in order of time."""
    return audit.where(F.col("document_id") == document_id).orderBy("timestamp")


def pipeline_totals(control: DataFrame) -> DataFrame:
    """How many documents there are in each status, and of them those in which a stage failed."""
    failed = F.exists(F.map_values("stage_status"), lambda s: s == "FAILED")
    return control.groupBy("status").agg(F.count("*").alias("n"), F.count_if(failed).alias("with_failed_stage"))


def write_named_files(rows: DataFrame, root: str) -> None:
    """rows(name, content): a file for each row, under names that a writer of Spark's wouldn't give; written by the tasks, among
    which the files are dealt out. A task that runs again writes the same files again."""

    def put(part) -> None:
        fs, base = file_system(root)
        for r in part:
            try:
                out = fs.open_output_stream(f"{base}/{r.name}", compression=None)
            except FileNotFoundError:
                fs.create_dir(f"{base}/{r.name}".rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(f"{base}/{r.name}", compression=None)
            with out:
                out.write(bytes(r.content))

    spread(rows.select("name", F.col("content").cast("binary").alias("content")), "name").foreachPartition(put)
