"""General analytics over the star schema: what any SQL engine is asked."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.sources.memories import table


def pricing(s, d):
    rows = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


def top_orders(s, d):
    orders, items = table(s, d, "orders"), table(s, d, "lineitem")
    customers = table(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    rows = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.groupBy("o_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def rollup_segment(s, d):
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cube_flags(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def window_rank(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")


def asof_events(s, d):
    """Each purchase with the user's last view before it: one pass over both in order, no range join."""
    rows = table(s, d, "events").where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return rows.select("event_id", "event_type", seen.alias("view_id")).where("event_type = 'purchase'").select("event_id", "view_id")


def setops(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return part(a.intersect(b), "both").unionByName(part(a.exceptAll(b.distinct()), "only_customers")).unionByName(part(a.union(b).distinct(), "either"))


ALL = {
    "tpch_q1_like": (pricing, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "tpch_q3_like": (top_orders, "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10"),
    "rollup_segment": (rollup_segment, "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)"),
    "cube_flags": (cube_flags, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "window_rank_orders": (window_rank, "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS k FROM orders) WHERE k <= 3"),
    "asof_events": (asof_events, "SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id) WHERE p.event_type = 'purchase' GROUP BY p.event_id"),
    "setops_keys": (setops, "SELECT 'both' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)"),
}
