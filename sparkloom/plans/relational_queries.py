"""Filters, joins, aggregates, windows, top-k, set operations, recursion and row changes on the relational tables.

Money is summed as decimals and given as double, so a total does not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import mutations
from sparkloom.operators.graph import reached
from sparkloom.plans.registry import register, register_sql
from sparkloom.session import read_table


def cents(column: str):
    return F.col(column).cast("decimal(18,2)")


@register(
    """SELECT c.c_custkey, count(o.o_orderkey) AS total_orders, coalesce(sum(o.o_totalprice::DECIMAL(18,2))::DOUBLE, 0) AS total_amount,
       coalesce(sum(o.o_totalprice::DECIMAL(18,2))::DOUBLE / count(o.o_totalprice), 0) AS average_amount, max(o.o_orderdate) AS last_order
       FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"""
)
def customer_order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    # aggregated below the join: customers without orders are added after, so the large side shuffles sums only
    sums = orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"),
        F.sum(cents("o_totalprice")).cast("double").alias("amount"),
        (F.sum(cents("o_totalprice")).cast("double") / F.count("o_totalprice")).alias("mean"),
        F.max("o_orderdate").alias("last_order"),
    )
    return customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey",
        F.coalesce("n", F.lit(0)).alias("total_orders"),
        F.coalesce("amount", F.lit(0.0)).alias("total_amount"),
        F.coalesce("mean", F.lit(0.0)).alias("average_amount"),
        "last_order",
    )


# Filters, projections and scalar functions.

register_sql(
    "orders_between_dates",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus IN ('O', 'F')
    AND o_totalprice IS NOT NULL AND o_orderpriority <> '5-LOW'""",
)
register_sql(
    "customer_search",
    """SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE lower('%CUSTOMER%1%') AND c_mktsegment = 'BUILDING'
    AND (c_acctbal > 0 OR c_nationkey = 3) ORDER BY c_custkey LIMIT 20 OFFSET 10""",
)
register_sql(
    "priority_buckets",
    """SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'large' END AS bucket,
    COUNT(*) AS n, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders GROUP BY 1""",
)
register_sql(
    "scalar_strings",
    """SELECT p_partkey, upper(p_brand) AS brand, left(p_name, 8) AS head, right(p_type, 4) AS tail, CAST(length(p_name) AS INT) AS n,
    repeat('*', p_size % 4) AS stars, replace(p_type, ' ', '_') AS slug, trim(concat('  ', p_brand, '  ')) AS trimmed,
    lpad(CAST(p_size AS VARCHAR(9)), 5, '0') AS padded, substring(p_name, 2, 3) AS middle, reverse(p_brand) AS mirrored,
    md5(p_name) AS name_id FROM part""",
)
register_sql(
    "scalar_numbers",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
    l_extendedprice * (1 - l_discount) AS net, abs(l_discount - l_tax) AS gap, CAST(ceil(l_quantity / 7) AS BIGINT) AS sevens,
    CAST(floor(sqrt(l_quantity)) AS BIGINT) AS root, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS least,
    coalesce(nullif(l_discount, 0), -1) AS discount, CAST(l_quantity AS BIGINT) % 5 AS rest FROM lineitem""",
)
register_sql(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS first_of_month,
    CAST(o_orderdate AS DATE) AS day, o_orderdate + INTERVAL '7' DAY AS due FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-06-01' - INTERVAL '90' DAY""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first_of_month,
    CAST(o_orderdate AS DATE) AS day, o_orderdate + INTERVAL 7 DAY AS due FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-06-01' - INTERVAL 90 DAY""",
)


@register(
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.missing') AS BIGINT), -1) AS missing,
    try_cast(event_type AS BIGINT) AS bad FROM events"""
)
def json_paths_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lookups with a default, and casts that give null where they fail."""
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"),
        F.coalesce(F.expr("try_cast(get_json_object(props, '$.missing') AS BIGINT)"), F.lit(-1).cast("long")).alias("missing"),
        F.expr("try_cast(event_type AS BIGINT)").alias("bad"),
    )


@register(
    """WITH numbered AS (SELECT p_partkey, p_name, p_type, p_retailprice, row_number() OVER (ORDER BY p_partkey) AS n FROM part)
    SELECT CAST(n AS BIGINT) AS row_number, printf('REC_%05d', n) AS record_id,
    upper(left(split_part(p_type, ' ', 1), 1) || left(split_part(p_type, ' ', 2), 1)) || '-' || printf('%04d', p_partkey) AS sku FROM numbered"""
)
def record_and_sku_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered records with formatted ids; numbers come from ranges of the key, so no task holds all rows."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    initials = F.array_join(F.transform(F.slice(F.split("p_type", " "), 1, 2), lambda w: F.left(w, F.lit(1))), "")
    return global_row_number(part, "p_partkey").select(
        F.col("n").alias("row_number"),
        F.format_string("REC_%05d", "n").alias("record_id"),
        F.concat(F.upper(initials), F.lit("-"), F.format_string("%04d", "p_partkey")).alias("sku"),
    )


def global_row_number(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Row numbers from 1 over the whole table in order of a unique key: numbered within ranges of the key that hold about as
    many rows each (by quantiles, so gaps and crowds of keys don't matter), and moved by the sizes of the ranges before."""
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    dealt = rows.withColumn("__r", F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b < F.col(key))) if bounds else F.lit(0))
    sizes = dealt.groupBy("__r").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__r", before.alias("__before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(key))
    return dealt.join(F.broadcast(offsets), "__r").withColumn(name, (inside + F.col("__before")).cast("long")).drop("__r", "__before")


register_sql("read_only_orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10")
register_sql("pending_oldest_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey LIMIT 10")

# Joins.

register_sql(
    "orders_with_customers",
    """SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
register_sql(
    "product_catalog",
    """SELECT DISTINCT p.p_partkey, p.p_name, s.s_name, n.n_name, r.r_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE p.p_retailprice > 100""",
)
def _vendor_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier with what its lines and its nation's customers sum up to; each side is summed below the join."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"), F.count("*").alias("lines")
    )
    buyers = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("customers"), F.sum(cents("c_acctbal")).alias("balance"))
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = suppliers.join(lines, "s_suppkey", "left").join(buyers, "s_nationkey", "left")
    return joined.na.fill(0, ["parts", "returned", "lines", "customers"])


@register(
    """SELECT s.s_suppkey, COUNT(DISTINCT l.l_partkey) AS parts, COUNT(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_partkey END) AS returned,
    COUNT(DISTINCT c.c_custkey) AS customers, CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey LEFT JOIN customer c ON c.c_nationkey = s.s_nationkey GROUP BY s.s_suppkey"""
)
def vendor_summary_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summary over both joins gives, where every customer counts once for each line: the same sums, multiplied by
    the lines, without the rows of the fan-out."""
    fanned = (F.col("balance") * F.greatest("lines", F.lit(1))).cast("double").alias("balance")
    return _vendor_sides(spark, sf_dir).select("s_suppkey", "parts", "returned", "customers", fanned)


@register(
    """WITH li AS (SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned FROM lineitem GROUP BY 1),
    cu AS (SELECT c_nationkey, COUNT(*) AS customers, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer GROUP BY 1)
    SELECT s_suppkey, coalesce(parts, 0) AS parts, coalesce(returned, 0) AS returned, coalesce(customers, 0) AS customers, balance
    FROM supplier LEFT JOIN li ON l_suppkey = s_suppkey LEFT JOIN cu ON c_nationkey = s_nationkey"""
)
def vendor_summary_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summary without fan-out."""
    return _vendor_sides(spark, sf_dir).select("s_suppkey", "parts", "returned", "customers", F.col("balance").cast("double").alias("balance"))


register_sql(
    "nation_pairs_of_a_region",
    "SELECT a.n_name AS name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
register_sql(
    "customers_without_recent_orders",
    """SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') o
    ON c.c_custkey = o.o_custkey WHERE o.o_custkey IS NULL""",
)
register_sql(
    "parts_never_returned",
    "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')",
)
register_sql(
    "verified_purchase_flag",
    """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000) THEN 'verified' ELSE 'plain' END AS flag
    FROM customer c""",
)
register_sql(
    "promotions_by_pattern",
    """SELECT p.p_partkey, r.r_name FROM part p JOIN region r ON p.p_size BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 8
    AND p.p_type LIKE concat('%', left(r.r_name, 1), '%')""",
)
register_sql(
    "orders_that_do_not_add_up",
    """SELECT o.o_orderkey, o.o_totalprice, t.total FROM orders o JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM lineitem GROUP BY l_orderkey) t ON o.o_orderkey = t.l_orderkey AND o.o_totalprice <> t.total WHERE o.o_orderstatus = 'O'""",
)
register_sql(
    "revenue_by_nation_and_year",
    """SELECT n.n_name, CAST(year(o.o_orderdate) AS INT) AS y, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS lines
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    GROUP BY n.n_name, 2""",
)
register_sql(
    "full_outer_of_keys",
    """SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM
    (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal < -900 GROUP BY 1) c FULL JOIN
    (SELECT s_nationkey, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.c_nationkey = s.s_nationkey""",
)


@register(
    """SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey)::VARCHAR AS order_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def customers_with_their_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent with the ordered list of its children; none gives a list of one null, as an outer join does."""
    pending = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey")
    lists = customers.join(pending, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("o"))
    text = F.array_join(F.transform("o", lambda s: F.coalesce(s["o_orderkey"].cast("string"), F.lit("NULL"))), ", ")
    return lists.select("c_custkey", F.concat(F.lit("["), text, F.lit("]")).alias("order_keys"))


# Aggregates.

register_sql(
    "return_rates",
    """SELECT l_suppkey, COUNT(*) AS lines, ROUND(CAST(100 AS DOUBLE) * SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / COUNT(*), 2) AS return_rate,
    COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 5""",
    """SELECT l_suppkey, COUNT(*) AS lines, ROUND(CAST(100 AS DOUBLE) * SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / COUNT(*), 2) AS return_rate,
    COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 5""",
)


@register(
    """SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done,
    round(CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(COUNT(*), 0), 6) AS rate FROM orders GROUP BY 1"""
)
def completion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), done.alias("done"), F.round(done.cast("double") / F.count("*"), 6).alias("rate"))


register_sql(
    "monthly_orders",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
    COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY date_trunc('month', o_orderdate)""",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
    COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
)
register_sql(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)


@register(
    """SELECT l_returnflag, round(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))::DOUBLE / count(*), 6) AS mean_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def mean_shipping_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag").agg(F.round(F.sum(days).cast("double") / F.count("*"), 6).alias("mean_days"))


register_sql(
    "above_average_segments",
    """SELECT s.c_mktsegment, s.n, s.balance FROM (SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer GROUP BY c_mktsegment) s WHERE s.n > (SELECT COUNT(*) FROM customer) / 5.2""",
)
register_sql(
    "rollup_by_flag_and_status",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
register_sql(
    "cube_of_segments",
    "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
)
register_sql(
    "grouping_sets_of_parts",
    "SELECT p_brand, p_size, COUNT(*) AS n, MAX(p_retailprice) AS most FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
)
register_sql(
    "table_counts",
    """SELECT 'customer' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'orders' AS name, COUNT(*) AS n FROM orders
    UNION ALL SELECT 'part' AS name, COUNT(*) AS n FROM part UNION ALL SELECT 'lineitem' AS name, COUNT(*) AS n FROM lineitem""",
)


@register(
    """WITH ranked AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, max(n) AS n, max(CASE WHEN r = n // 2 + 1 THEN x END) AS median, max(CASE WHEN r = n // 4 + 1 THEN x END) AS p25, max(CASE WHEN r = 3 * n // 4 + 1 THEN x END) AS p75,
    min(x) AS least, max(x) AS most FROM ranked GROUP BY 1"""
)
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and quartiles: the elements at n/2, n/4 and 3n/4 of the sorted values, from 0. Worked out on the counts of
    distinct values, so the window over a brand grows with its values, not with its rows."""
    values = read_table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_retailprice").alias("x")).agg(F.count("*").alias("times"))
    w = Window.partitionBy("p_brand")
    ranked = values.withColumns({"upto": F.sum("times").over(w.orderBy("x")), "n": F.sum("times").over(w)})
    at = lambda e: F.min(F.when(F.col("upto") > F.expr(e), F.col("x")))
    return ranked.groupBy("p_brand").agg(F.max("n").alias("n"), at("n div 2").alias("median"), at("n div 4").alias("p25"), at("(3 * n) div 4").alias("p75"), F.min("x").alias("least"), F.max("x").alias("most"))


# Windows.

@register(
    """SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS BIGINT) AS price_rank,
    CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS size_rank FROM part"""
)
def price_and_size_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a brand, of which there are few at any size: from the counts of its distinct values, joined back."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    before = Window.partitionBy("p_brand").orderBy("p_retailprice").rowsBetween(Window.unboundedPreceding, -1)
    prices = part.groupBy("p_brand", "p_retailprice").agg(F.count("*").alias("times"))
    prices = prices.select("p_brand", "p_retailprice", (F.coalesce(F.sum("times").over(before), F.lit(0)) + 1).alias("price_rank"))
    sizes = part.select("p_brand", "p_size").distinct()
    sizes = sizes.withColumn("size_rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).cast("long"))
    return part.join(prices, ["p_brand", "p_retailprice"]).join(sizes, ["p_brand", "p_size"]).select("p_partkey", "price_rank", "size_rank")


register_sql(
    "latest_orders_per_customer",
    """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3""",
)
register_sql(
    "running_totals",
    """SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders""",
)
register_sql(
    "keyed_id_counter",
    """SELECT concat('p', CAST(p_size AS VARCHAR(9)), '_', p_brand, '_', CAST(row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS VARCHAR(9))) AS id, p_partkey FROM part""",
)
register_sql(
    "top_customers",
    """SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY o_custkey ORDER BY amount DESC NULLS LAST, o_custkey LIMIT 25""",
)

# Set operations and recursion.

register_sql("nations_of_both", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000")
register_sql("nations_of_customers_only", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 9000")
register_sql("distinct_status_pairs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_TREE = """WITH RECURSIVE tree AS (SELECT p_partkey, CAST(NULL AS BIGINT) AS parent, 1 AS level FROM part WHERE p_partkey <= 3
    UNION ALL SELECT p.p_partkey, t.p_partkey AS parent, t.level + 1 AS level FROM part p JOIN tree t ON (p.p_partkey - p.p_partkey % 4) / 4 = t.p_partkey WHERE p.p_partkey > 3)
    SELECT p_partkey, parent, level FROM tree"""


@register(_TREE)
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the roots reach, however deep: a level is one join of the level before with the table."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).alias("parent"))
    tree = part.where("p_partkey <= 3").select("p_partkey", F.lit(None).cast("long").alias("parent"), F.lit(1).alias("level"))
    return reached(tree, part.where("p_partkey > 3"), "p_partkey", "parent", "level")


# Row changes.


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.select((F.col("o_custkey") * 2).alias("c_custkey"), F.concat(F.lit("order "), "o_orderkey").alias("c_name"), F.lit(7).alias("c_nationkey"), "o_orderkey")


_CHANGES = "(SELECT o_custkey * 2 AS c_custkey, 'order ' || o_orderkey AS c_name, 7 AS c_nationkey, o_orderkey FROM orders)"


@register(
    f"""WITH ch AS (SELECT c_custkey, c_name, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS r FROM {_CHANGES}) WHERE r = 1)
    SELECT c_custkey, c_name, c_nationkey FROM ch UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch)"""
)
def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(None).cast("long").alias("o_orderkey"))
    return mutations.upsert(table, _changes(spark, sf_dir), ["c_custkey"], F.col("o_orderkey")).drop("o_orderkey")


@register(
    f"""WITH ch AS (SELECT c_custkey, c_name, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM {_CHANGES}) WHERE r = 1)
    SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey FROM ch WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def insert_new_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(None).cast("long").alias("o_orderkey"))
    return mutations.insert_new(table, _changes(spark, sf_dir), ["c_custkey"], F.col("o_orderkey")).drop("o_orderkey")


@register(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"""
)
def update_overdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return mutations.update_where(table, F.col("c_acctbal") < 0, c_mktsegment=F.lit("overdrawn"), c_acctbal=F.lit(0.0))


@register("SELECT p_partkey, p_brand FROM part p WHERE NOT (p_size > 30 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45))")
def delete_unreferenced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return mutations.delete_unreferenced(part, part.where("p_size > 30"), "p_partkey", lines, "l_partkey").drop("p_size")


_DOCUMENT_STATES = """(SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
    CAST(o_orderkey % 5 AS INT) AS retry_count, o_orderdate AS updated_at, CAST(NULL AS VARCHAR) AS owner FROM orders)"""


def _document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("retry_count"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("string").alias("owner")
    )


@register(
    f"""WITH t AS (SELECT * FROM {_DOCUMENT_STATES}), w AS (SELECT l_orderkey AS document_id, min('worker' || l_suppkey % 9) AS o FROM lineitem GROUP BY 1)
    SELECT t.document_id, CASE WHEN status = 'PENDING' AND o IS NOT NULL THEN 'IN_PROGRESS' ELSE status END AS status, CASE WHEN status = 'PENDING' THEN o END AS owner FROM t LEFT JOIN w USING (document_id)"""
)
def claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("worker"), F.col("l_suppkey") % 9).alias("owner"))
    return mutations.claim(_document_states(spark, sf_dir), wanted, "document_id").select("document_id", "status", "owner")


@register(
    f"""WITH t AS (SELECT * FROM {_DOCUMENT_STATES}), c AS (SELECT document_id FROM t WHERE status = 'FAILED' AND retry_count < 3 AND updated_at <= TIMESTAMP '1996-01-01' ORDER BY updated_at, document_id LIMIT 50)
    SELECT document_id, CASE WHEN document_id IN (FROM c) THEN 'PENDING' ELSE status END AS status, CAST(retry_count + CAST(document_id IN (FROM c) AS INT) AS INT) AS retry_count FROM t"""
)
def requeue_failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.lit("1996-01-01").cast("timestamp_ntz")
    return mutations.requeue_failed(_document_states(spark, sf_dir), cutoff, 3, 50).select("document_id", "status", "retry_count")


@register("SELECT event_id, floor(epoch(ts))::BIGINT + 86400 * (event_id % 20) AS expires_at FROM events WHERE floor(epoch(ts))::BIGINT + 86400 * (event_id % 20) > epoch(TIMESTAMP '2024-01-25')::BIGINT")
def unexpired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) + 86400 * (F.col("event_id") % 20)).alias("expires_at"))
    return mutations.unexpired(events, F.unix_timestamp(F.lit("2024-01-25").cast("timestamp")))


@register(
    """SELECT p_partkey, 'name has no digits' AS broken FROM part WHERE NOT regexp_matches(p_name, '^[^0-9]*$') UNION ALL SELECT p_partkey, 'price over 900' FROM part WHERE NOT p_retailprice > 900
    UNION ALL SELECT p_partkey, 'size known' FROM part WHERE NOT p_size IN (1, 5, 10, 20, 30, 40, 50)"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"name has no digits": F.col("p_name").rlike("^[^0-9]*$"), "price over 900": F.col("p_retailprice") > 900, "size known": F.col("p_size").isin(1, 5, 10, 20, 30, 40, 50)}
    return mutations.violations(read_table(spark, sf_dir, "part"), checks, ["p_partkey"])


@register(
    """SELECT p_partkey, CASE WHEN p_size % 6 = 0 AND p_partkey % 2 = 0 THEN 'out_of_stock' WHEN p_size % 6 > 0 AND p_partkey % 2 = 1 THEN 'active' WHEN p_partkey % 2 = 0 THEN 'active' ELSE 'out_of_stock' END AS status FROM part"""
)
def stock_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("stock_quantity"), F.when(F.col("p_partkey") % 2 == 0, "active").otherwise("out_of_stock").alias("status"))
    return mutations.with_stock_status(part).select("p_partkey", "status")
