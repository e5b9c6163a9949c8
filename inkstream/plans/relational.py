"""Queries on the star schema and the event stream: joins, sets, windows and grouping sets, which complete the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.sources.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial and final aggregation over the largest table."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins along the star; the small dimensions are broadcast by their size."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders"))


def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.where("o_totalprice > 400000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.where("o_totalprice > 400000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


def sales_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube."""
    li = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return li.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n")


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking: the three dearest orders of each customer (a top-k report)."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("r")).where("r <= 3").select("o_custkey", "o_orderkey", F.col("r").cast("bigint").alias("r"))


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames: previous order and running total of each customer."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))


def parts_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of part keys by return flag."""
    li = table(spark, sf_dir, "lineitem")
    a, r = (li.where(F.col("l_returnflag") == f).select("l_partkey") for f in ("A", "R"))
    return a.intersect(r).select(F.lit("both").alias("side"), "l_partkey").unionByName(a.distinct().exceptAll(r.distinct()).select(F.lit("A only").alias("side"), "l_partkey"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of 30 minutes of each user."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def purchase_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the last event of another type before each purchase, over one sorted union instead of a range join."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    other = F.when(F.col("event_type") != "purchase", F.col("event_id"))
    return e.select("event_id", "event_type", F.last(other, ignorenulls=True).over(w).alias("before")).where("event_type = 'purchase'").select("event_id", "before")


_FUNCTIONS = (pricing_summary, revenue_by_nation, customers_without_large_orders, customers_with_large_orders, sales_cube, top_orders_per_customer, order_gaps, parts_in_both, event_windows, event_sessions, purchase_context)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "customers_without_large_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "customers_with_large_orders": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "sales_cube": "SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3",
    "order_gaps": "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "parts_in_both": "WITH a AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT 'both' AS side, l_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM r) UNION ALL SELECT 'A only', l_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM r)",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1",
    "purchase_context": "WITH e AS (SELECT event_id, event_type, last_value(CASE WHEN event_type <> 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT event_id, before FROM e WHERE event_type = 'purchase'",
}
