"""Change events: typed values, routing, differences, and the validation of uploaded products."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.mutations import keep_last

#: The fields of a product, which must be there, and their longest texts.
PRODUCT = "vendor_product_id string, product_name string, category string, subcategory string, description string, sku string, brand string, price double, compare_at_price double, stock_quantity int, unit string, weight_kg double, dimensions_cm string, image_url string"
REQUIRED = ("vendor_product_id", "product_name", "category", "sku", "price", "stock_quantity")
LIMITS = {"product_name": 200, "description": 2000, "sku": 100, "brand": 100, "vendor_product_id": 100}


def plain_value(typed):
    """A tagged wire value ({'S': ..}, {'N': ..}, {'M': ..}, ...) as a plain one; an unknown tag stays as it is."""
    if not isinstance(typed, dict) or len(typed) != 1:
        return typed
    ((tag, value),) = typed.items()
    if tag == "S":
        return value
    if tag == "N":
        return Decimal(value)
    if tag == "BOOL":
        return bool(value)
    if tag == "NULL":
        return None
    if tag == "M":
        return {k: plain_value(v) for k, v in value.items()}
    if tag == "L":
        return [plain_value(v) for v in value]
    if tag in ("SS", "NS"):
        return sorted({Decimal(v) if tag == "NS" else v for v in value})
    return typed


def route(events: DataFrame) -> DataFrame:
    """What is done with each event; unknown names are kept and marked."""
    action = F.when(F.col("eventName") == "INSERT", "insert").when(F.col("eventName") == "MODIFY", "modify").when(F.col("eventName") == "REMOVE", "remove").otherwise("unknown")
    return events.withColumn("action", action)


def changes(old: Column, new: Column) -> Column:
    """map(field -> struct(old, new)) of what differs between two images (maps of strings): changed, added and removed fields;
    none if either image is empty or missing, and a new field whose value is null is no change."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    differs = F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))
    some = (F.size(F.map_keys(old)) > 0) & (F.size(F.map_keys(new)) > 0)
    return F.when(some, differs).otherwise(F.map_filter(both, lambda k, v: F.lit(False)))


def _missing(c: str) -> Column:
    """Empty texts and zeros count as missing."""
    value = F.col(c)
    return value.isNull() | (F.trim(value.cast("string")) == "") | (value.cast("string").isin("0", "0.0"))


def validated(uploads: DataFrame, categories: DataFrame, products: DataFrame) -> DataFrame:
    """uploads(upload_id, vendor_id, record_id, row_number, fields of PRODUCT): with status, error_type and error_message of
    the first rule that fails, in the order required fields, price, stock, category, lengths, sku, vendor product id. Taken
    keys are those in products, and those of an earlier row of the same upload."""
    absent = F.array_compact(F.array(*[F.when(_missing(c), F.lit(c)) for c in REQUIRED]))
    too_long = F.array_compact(F.array(*[F.when(F.length(c) > n, F.lit(f"{c} exceeds {n} characters")) for c, n in LIMITS.items()]))
    active = categories.where("is_active").select(F.col("category_name").alias("category"), F.lit(True).alias("__known")).distinct()
    skus = products.select("sku", F.lit(True).alias("__sku_taken")).distinct()
    owned = products.select("vendor_id", "vendor_product_id", F.lit(True).alias("__vpid_taken")).distinct()
    again = lambda *keys: (F.row_number().over(Window.partitionBy("upload_id", *keys).orderBy("row_number")) > 1) & F.col(keys[-1]).isNotNull()
    rows = uploads.withColumns({"__sku_again": again("sku"), "__vpid_again": again("vendor_id", "vendor_product_id")})
    rows = rows.join(active, "category", "left").join(skus, "sku", "left").join(owned, ["vendor_id", "vendor_product_id"], "left")
    rules = [
        (F.size(absent) > 0, "MISSING_REQUIRED_FIELDS", F.concat(F.lit("Missing required fields: "), F.array_join(absent, ", "))),
        (~F.col("price").between(0.01, 999999.99), "INVALID_PRICE", F.concat(F.lit("Price out of range: "), F.col("price").cast("string"))),
        (~F.col("stock_quantity").between(0, 1_000_000), "INVALID_STOCK", F.concat(F.lit("Stock out of range: "), F.col("stock_quantity").cast("string"))),
        (F.size(too_long) > 0, "FIELD_TOO_LONG", F.array_join(too_long, "; ")),
        (F.col("__known").isNull(), "INVALID_CATEGORY", F.concat(F.lit("Unknown or inactive category: "), "category")),
        (F.col("__sku_taken").isNotNull() | F.col("__sku_again"), "DUPLICATE_SKU", F.concat(F.lit("SKU already exists: "), "sku")),
        (F.col("__vpid_taken").isNotNull() | F.col("__vpid_again"), "DUPLICATE_VENDOR_PRODUCT", F.concat(F.lit("Vendor product already exists: "), "vendor_product_id")),
    ]
    kind = F.coalesce(*[F.when(test, F.lit(name)) for test, name, _ in rules])
    text = F.coalesce(*[F.when(test, message) for test, _, message in rules])
    judged = rows.withColumns({"error_type": kind, "error_message": text, "status": F.when(kind.isNull(), "validated").otherwise("error")})
    return judged.select(*uploads.columns, "status", "error_type", "error_message")


#: The columns of an error file.
ERROR_COLUMNS = ("row_number", "record_id", "vendor_product_id", "product_name", "category", "sku", "price", "stock_quantity", "description", "error_type", "error_message")


def error_rows(judged: DataFrame) -> DataFrame:
    """What goes into the error files: fixed columns, descriptions cut at 100 characters; no row without an upload."""
    cut = [F.left("description", F.lit(100)).alias(c) if c == "description" else F.col(c) for c in ERROR_COLUMNS]
    return judged.where("status = 'error' and upload_id is not null").select("vendor_id", "upload_id", *cut)


def write_error_files(judged: DataFrame, path: str) -> None:
    """errors/{vendor}/{upload}: one sorted CSV with a header for each upload."""
    rows = error_rows(judged).repartition("vendor_id", "upload_id").sortWithinPartitions("vendor_id", "upload_id", "row_number")
    rows.write.mode("overwrite").partitionBy("vendor_id", "upload_id").option("header", True).csv(path)


def upload_summary(judged: DataFrame, history: DataFrame) -> DataFrame:
    """Counts of each upload against its history; complete once valid and bad rows are all."""
    sums = judged.where("upload_id is not null").groupBy("upload_id").agg(F.count_if(F.col("status") == "validated").alias("valid_records"), F.count_if(F.col("status") == "error").alias("error_records"))
    joined = history.join(sums, "upload_id", "left").na.fill(0, ["valid_records", "error_records"])
    done = F.col("valid_records") + F.col("error_records") == F.col("total_records")
    return joined.withColumn("status", F.when(done & (F.col("error_records") == 0), "completed").when(done, "completed_with_errors").otherwise("processing"))


def grouped_errors(errors: DataFrame) -> DataFrame:
    """The errors of each upload as one list in row order."""
    item = F.struct("row_number", "record_id", "error_type", "error_message")
    return errors.where("upload_id is not null").groupBy("upload_id").agg(F.array_sort(F.collect_list(item)).alias("errors"))


def daily_metrics(rows: DataFrame) -> DataFrame:
    """rows(date, metric_type, value, seq): the last write of each metric and day."""
    return keep_last(rows, ["date", "metric_type"], F.col("seq"))


WIRE = "S string, N string, BOOL boolean, NULL boolean, L array<struct<S:string,N:string>>, SS array<string>, NS array<string>"


def wire_value(tagged: Column) -> Column:
    """JSON of a tagged value as plain text: strings and numbers as they are, lists and sets (sorted, once each) joined by
    commas; null for NULL, and the JSON itself for an unknown tag."""
    v = F.from_json(tagged, WIRE)
    many = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    listed = F.array_join(F.transform(v["L"], lambda x: F.coalesce(x["S"], x["N"])), ",")
    known = F.coalesce(v["S"], v["N"], v["BOOL"].cast("string"), listed, many(v["SS"]), many(F.transform(v["NS"], lambda n: n.cast("decimal(38,10)")).cast("array<double>").cast("array<string>")))
    return F.when(v["NULL"], F.lit(None).cast("string")).otherwise(F.coalesce(known, tagged))


def nested_value(tagged: Column, depth: int = 4) -> Column:
    """JSON text of a value whose parts are tagged with their types, of any shape up to a depth, as JSON text without tags: maps
    in the order of their keys, sets sorted and each member once. An unknown tag, or what lies deeper, stays as it is; what
    is no JSON is null."""
    return _untagged(F.try_parse_json(tagged), depth)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _untagged(v: Column, depth: int) -> Column:
    return _let(F.struct(F.try_variant_get(v, "$", "map<string,variant>").alias("parts"), v.alias("whole")), lambda x: _by_tag(x["parts"], x["whole"], depth))


def _by_tag(parts: Column, whole: Column, depth: int) -> Column:
    tag, inner = F.when(F.size(parts) == 1, F.element_at(F.map_keys(parts), 1)), F.element_at(F.map_values(parts), 1)
    of = lambda kind: F.try_variant_get(inner, "$", kind)
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    numbers = F.array_sort(F.array_distinct(F.transform(of("array<string>"), lambda n: n.cast("decimal(38,10)"))))
    out = F.when(tag == "S", _quoted(of("string"))).when(tag == "N", of("string")).when(tag == "BOOL", of("boolean").cast("string")).when(tag == "NULL", F.lit("null"))
    out = out.when(tag == "SS", listed(F.transform(F.array_sort(F.array_distinct(of("array<string>"))), _quoted)))
    out = out.when(tag == "NS", listed(F.transform(numbers, lambda n: F.rtrim(F.rtrim(n.cast("string"), F.lit("0")), F.lit(".")))))
    if depth:
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        entries = F.array_sort(F.map_entries(of("map<string,variant>")), by_key)
        member = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _untagged(e["value"], depth - 1))
        out = out.when(tag == "M", F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ","), F.lit("}")))
        out = out.when(tag == "L", listed(F.transform(of("array<variant>"), lambda x: _untagged(x, depth - 1))))
    return out.otherwise(F.to_json(whole))


def written_back(records: DataFrame, judged: DataFrame, now: Column) -> DataFrame:
    """records(upload_id, record_id, status, error_reason, error_details, processed_at) with what was judged put in by key: the
    reason and details change only where there is one."""
    found = judged.groupBy("upload_id", "record_id").agg(F.max(F.struct("row_number", "status", "error_type", "error_message")).alias("j"))
    rows = records.join(found, ["upload_id", "record_id"], "left")
    hit, reason = F.col("j").isNotNull(), F.col("j.error_type")
    return rows.withColumns({
        "status": F.when(hit, F.col("j.status")).otherwise(F.col("status")), "processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
        "error_reason": F.coalesce(reason, "error_reason"), "error_details": F.when(reason.isNotNull(), F.col("j.error_message")).otherwise(F.col("error_details")),
    }).drop("j")


def error_file_path(vendor: Column, upload: Column) -> Column:
    return F.concat(F.lit("errors/"), vendor, F.lit("/"), upload, F.lit("_errors.csv"))
