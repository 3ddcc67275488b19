"""Row changes as table rewrites: a new DataFrame replaces the table in one commit, so each is all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the order; what an upsert of a batch with repeated keys leaves."""
    newest = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert, or update on conflict: changes win over the table's rows; the last of several changes wins. One shuffle."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return keep_last(both, keys, F.col("__new"), *order).drop("__new")


def insert_new(table: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert, or do nothing on conflict: the table's rows win; the first of several new rows wins."""
    first = Window.partitionBy(*keys).orderBy("__new", *order)
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__new")


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds; unknown is not true."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_fields(table: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Partial update: of the allowed fields, those that a change supplies (not null) replace the row's."""
    names = [c for c in allowed if c in changes.columns]
    found = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return table.join(found, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_unreferenced(table: DataFrame, gone: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Deletes the rows that nothing refers to; the others are refused and stay."""
    free = gone.select(key).distinct().join(child.select(F.col(child_key).alias(key)).distinct(), key, "left_anti")
    return table.join(free, key, "left_anti")


def claim(table: DataFrame, wanted: DataFrame, key: str, owner: str = "owner", now: Column | None = None) -> DataFrame:
    """Compare and set PENDING to IN_PROGRESS: of several claims of a row the first owner by name wins, and a row that isn't
    pending stays as it is."""
    first = wanted.groupBy(key).agg(F.min(owner).alias("__owner"))
    won = (F.col("status") == "PENDING") & F.col("__owner").isNotNull()
    rows = table.join(first, key, "left")
    changed = {"status": F.when(won, "IN_PROGRESS").otherwise(F.col("status")), owner: F.when(won, F.col("__owner")).otherwise(F.col(owner))}
    if now is not None:
        changed["updated_at"] = F.when(won, now).otherwise(F.col("updated_at"))
    return rows.withColumns(changed).drop("__owner")


def requeue_failed(table: DataFrame, cutoff: Column, most_retries: int, limit: int) -> DataFrame:
    """Failed rows with retries left that are old enough go back to PENDING, oldest first, ``limit`` at most."""
    able = table.where((F.col("status") == "FAILED") & (F.col("retry_count") < most_retries) & (F.col("updated_at") <= cutoff))
    chosen = able.orderBy("updated_at", "document_id").limit(limit).select("document_id", F.lit(True).alias("__again"))
    again = F.coalesce(F.col("__again"), F.lit(False))
    rows = table.join(chosen, "document_id", "left")
    return rows.withColumns({"status": F.when(again, "PENDING").otherwise(F.col("status")), "retry_count": F.col("retry_count") + again.cast("int")}).drop("__again")


def unexpired(table: DataFrame, now: Column, field: str = "expires_at") -> DataFrame:
    return table.where(F.col(field) > now)


def violations(table: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row for each check that a row breaks; a check that is unknown holds, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    return table.select(*keys, F.explode(broken).alias("broken"))


def with_stock_status(products: DataFrame) -> DataFrame:
    """What the stock trigger keeps: no stock makes active rows out_of_stock, and stock makes those active again."""
    status = F.when((F.col("stock_quantity") == 0) & (F.col("status") == "active"), "out_of_stock").when((F.col("stock_quantity") > 0) & (F.col("status") == "out_of_stock"), "active")
    return products.withColumn("status", F.coalesce(status, F.col("status")))


def touched(before: DataFrame, after: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> DataFrame:
    """What the timestamp trigger keeps: rows of after that differ from before get the stamp; new rows keep their own."""
    names = [c for c in after.columns if c not in (key, stamp)]
    old = before.select(key, F.struct(*names).alias("__old"))
    changed = F.col("__old").isNotNull() & ~F.struct(*names).eqNullSafe(F.col("__old"))
    return after.join(old, key, "left").withColumn(stamp, F.when(changed, now).otherwise(F.col(stamp))).drop("__old")


def with_duration(uploads: DataFrame) -> DataFrame:
    """What the duration trigger keeps: whole seconds from start to completion, where both are known."""
    took = (F.col("processing_completed_at").cast("timestamp").cast("double") - F.col("processing_started_at").cast("timestamp").cast("double"))
    return uploads.withColumn("processing_duration_seconds", F.coalesce(F.round(took).cast("int"), F.col("processing_duration_seconds")))


def transacted(table: DataFrame, items: DataFrame, key: str, request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Requests of several writes, each applied whole or not at all. items(request, key, op, expects, holds, columns) say for each
    key of a request: op put, update, delete or check; what it expects of the row (exists, absent or null); ``holds``,
    a condition that was judged on the row (null: none); the columns of the table, null in an update where they stay.

    All items are judged against the same table. A request is refused if an item's expectation fails, if it names a key twice,
    or if one with a smaller id writes a key that it names. Returns the table after one commit of all accepted requests, and
    (request, accepted, reason)."""
    present = table.select(key, F.lit(True).alias("__there"), F.struct(*table.columns).alias("__row"))
    writes = items.where("op <> 'check'").groupBy(key).agg(F.min(request).alias("__first"))
    seen = items.join(present, key, "left").join(writes, key, "left")
    times = seen.withColumn("__times", F.count("*").over(Window.partitionBy(request, key)))
    there = F.coalesce("__there", F.lit(False))
    missing = (F.col("op").isin("update", "delete") | (F.col("expects") == "exists")) & ~there
    reason = (
        F.when(F.col("__times") > 1, "key named twice").when(missing, "no such row").when((F.col("expects") == "absent") & there, "row exists")
        .when(F.col("holds").isNotNull() & ~F.col("holds"), "condition fails").when(F.col("__first") < F.col(request), "conflict")
    )
    judged = times.withColumn("__reason", reason).groupBy(request).agg(F.min("__reason").alias("reason"))
    outcomes = judged.select(request, F.col("reason").isNull().alias("accepted"), "reason")
    won = items.where("op <> 'check'").join(outcomes.where("accepted"), request, "left_semi")
    rest = [c for c in table.columns if c != key]
    changes = won.select(key, F.col("op").alias("__op"), *[F.col(c).alias(f"__{c}") for c in rest])
    both = table.join(changes, key, "full_outer").where("__op is null or __op <> 'delete'")
    after = both.select(*[F.col(c) if c == key else F.when(F.col("__op") == "put", F.col(f"__{c}")).otherwise(F.coalesce(f"__{c}", c)).alias(c) for c in table.columns])
    return after, outcomes
