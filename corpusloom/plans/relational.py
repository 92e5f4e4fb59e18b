"""Joins, grouping sets, set operations and ranked results over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.similarity import small
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(revenue()), 2).alias("sum_disc"),
        F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name"""
)
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of equi-joins; Catalyst sends the small sides around where statistics allow."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, o_orderpriority, grouping(c_mktsegment)::INTEGER AS g_segment, grouping(o_orderpriority)::INTEGER AS g_priority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.cube("c_mktsegment", "o_orderpriority").agg(
        F.grouping("c_mktsegment").cast("int").alias("g_segment"), F.grouping("o_orderpriority").cast("int").alias("g_priority"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("SELECT r_name, n_name, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def supplier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose orders is in part delivered."""
    part = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(part, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) GROUP BY p_brand")
def bulk_part_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulk = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    return table(spark, sf_dir, "part").join(bulk, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem) WHERE l_quantity < 0.3 * mean"""
)
def small_quantity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under three tenths of their part's mean, as a correlated subquery would ask."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"))
    return li.join(mean, "l_partkey").where("l_quantity < 0.3 * mean").drop("mean")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, place::INTEGER AS place FROM r WHERE place <= 3"""
)
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(order).alias("place")).where("place <= 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def first_forty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY o_orderpriority"""
)
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", *(F.col(c).alias(c.lower()) for c in ("F", "O", "P")))


@query("(SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def nations_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    n = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("nationkey"))
    return c.intersect(s).subtract(n)


@query(
    """WITH b(band, low, high) AS (VALUES ('small', 0.0, 50000.0), ('middle', 50000.0, 150000.0), ('large', 150000.0, 1e12))
SELECT band, count(*)::BIGINT AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY band"""
)
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join with a three-row table of half-open intervals."""
    bands = spark.createDataFrame([("small", 0.0, 50000.0), ("middle", 50000.0, 150000.0), ("large", 150000.0, 1e12)], "band string, low double, high double")
    inside = (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))
    return table(spark, sf_dir, "orders").join(F.broadcast(bands), inside).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query(
    """SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id))
 AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND (q.ts < e.ts OR (q.ts = e.ts AND q.event_id < e.event_id)) AND (q.ts > p.ts OR (q.ts = p.ts AND q.event_id > p.event_id)))
 GROUP BY e.event_id"""
)
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last purchase before each event: an as-of join as one window over the user's events."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return table(spark, sf_dir, "events").select("event_id", last.alias("last_purchase"))


@query(
    """WITH t AS (SELECT o_custkey, o_orderdate::DATE AS d, sum(o_totalprice) AS day_total FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(d AS VARCHAR) AS order_day, round(day_total, 2) AS day_total, round(sum(day_total) OVER (PARTITION BY o_custkey ORDER BY d), 2) AS running,
 date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d)::INTEGER AS days_since FROM t"""
)
def customer_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("order_day")
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("order_day")).agg(F.sum("o_totalprice").alias("t"))
    return days.select(
        "o_custkey", F.col("order_day").cast("string").alias("order_day"), F.round("t", 2).alias("day_total"), F.round(F.sum("t").over(w), 2).alias("running"), F.datediff("order_day", F.lag("order_day").over(w)).alias("days_since")
    )


@query("SELECT year(o_orderdate)::INTEGER AS y, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def orders_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities")
    )


@query(
    """SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.n, 0)::BIGINT AS early, coalesce(b.n, 0)::BIGINT AS late, CASE WHEN a.k IS NULL THEN 'late only' WHEN b.k IS NULL THEN 'early only' WHEN a.n = b.n THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
 FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1) b ON a.k = b.k"""
)
def compare_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer comparison of two counts by key."""
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    a = o.where(F.col("o_orderdate") < cut).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("a"))
    b = o.where(F.col("o_orderdate") >= cut).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("b"))
    verdict = F.when(F.col("a").isNull(), "late only").when(F.col("b").isNull(), "early only").when(F.col("a") == F.col("b"), "MATCH").otherwise("MISMATCH")
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "custkey", "full_outer").select("custkey", z("a").alias("early"), z("b").alias("late"), verdict.alias("verdict"))


@query("SELECT p_brand, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers, round(median(l_quantity), 4) AS median_qty, round(stddev_samp(l_extendedprice), 2) AS sd_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def brand_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(
        F.count_distinct("l_suppkey").alias("n_suppliers"), F.round(F.median("l_quantity"), 4).alias("median_qty"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("sd_price")
    )


@query("SELECT n_name, count(c_custkey)::BIGINT AS n_customers, coalesce(round(sum(c_acctbal), 2), 0) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    joined = table(spark, sf_dir, "nation").join(small(per, "24"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("n_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("balance", F.lit(0.0)).alias("balance"))
