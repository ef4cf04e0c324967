"""Queries of range joins, latest-before lookups and exact quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.operators import ranges
from tablesteps.plans.catalogue import _HOT_KEY_SQL, _hot_orders, query, table


@query(
    "range_join",
    """WITH s AS (SELECT s_suppkey, s_acctbal AS low, s_acctbal + s_nationkey AS high FROM supplier)
       SELECT s.s_suppkey, s.low, s.high, c.c_custkey, c.c_acctbal FROM s JOIN customer c ON c.c_acctbal BETWEEN s.low AND s.high""",
)
def range_join(spark, d):
    """Customers whose balance lies in a supplier's band; bands of many lengths, some empty but for their ends."""
    bands = table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.col("s_nationkey")).alias("high")
    )
    points = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ranges.range_join(points, bands, "c_acctbal", "low", "high").select("s_suppkey", "low", "high", "c_custkey", "c_acctbal")


@query(
    "range_join_left",
    """WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate AS first_day, o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS last_day
               FROM orders)
       SELECT e.event_id, e.user_id, e.ts, w.o_orderkey, w.first_day, w.last_day
       FROM events e LEFT JOIN w ON e.user_id = w.o_custkey AND e.ts BETWEEN w.first_day AND w.last_day""",
)
def range_join_left(spark, d):
    """Events in the time windows of their user's orders; events in no window stay."""
    o = table(spark, d, "orders")
    days = F.make_dt_interval(F.pmod("o_orderkey", F.lit(40)).cast("int"))
    windows = o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("first_day"), (F.col("o_orderdate") + days).alias("last_day"))
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = ranges.range_join(events, windows, "ts", "first_day", "last_day", on=[("user_id", "o_custkey")], how="left")
    return out.drop("o_custkey")


_LATEST = """SELECT e.event_id, e.{user}, e.ts, o.o_orderkey, o.o_orderdate, o.o_totalprice
    FROM e LEFT JOIN o ON e.{user} = o.o_custkey AND o.o_orderdate <= e.ts
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) = 1"""


@query(
    "latest_before",
    "WITH e AS (SELECT event_id, user_id, ts + INTERVAL 400 DAY * (event_id % 9 - 4) AS ts FROM events), o AS (SELECT * FROM orders)"
    + _LATEST.format(user="user_id"),
)
def latest_before(spark, d):
    """The last order of the user up to each event (events moved over the years of the orders)."""
    e = table(spark, d, "events")
    moved = F.col("ts") + F.make_dt_interval((400 * (F.pmod("event_id", F.lit(9)) - 4)).cast("int"))
    events = e.select("event_id", "user_id", moved.alias("ts"))
    return ranges.latest_before(
        events, table(spark, d, "orders"), [("user_id", "o_custkey")], "ts", "o_orderdate", ["o_orderkey"],
        ["o_orderkey", "o_orderdate", "o_totalprice"],
    )


@query(
    "skew_latest_before",
    f"""WITH o AS (SELECT o_orderkey, {_HOT_KEY_SQL} AS o_custkey, o_orderdate, o_totalprice FROM orders),
    e AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS cust, l_shipdate AS ts
          FROM lineitem)"""
    """ SELECT e.event_id, e.cust, e.ts, o.o_orderdate, o.o_orderkey FROM e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM o GROUP BY ALL) o
        ON e.cust = o.o_custkey AND e.ts >= o.o_orderdate""",
)
def skew_latest_before(spark, d):
    """A third of the rows of both sides share one key, which fills many range partitions."""
    li = table(spark, d, "lineitem")
    cust = F.when(F.col("l_returnflag") == "R", F.lit(0).cast("long")).otherwise(F.col("l_suppkey"))
    lines = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), cust.alias("cust"), F.col("l_shipdate").alias("ts"))
    return ranges.latest_before(
        lines, _hot_orders(spark, d), [("cust", "o_custkey")], "ts", "o_orderdate", ["o_orderkey"], ["o_orderdate", "o_orderkey"]
    )


_QS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@query(
    "group_quantiles",
    f"""WITH g AS (SELECT l_returnflag, l_suppkey % 7 AS part, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, part, q, v[greatest(CAST(ceil(n * q) AS BIGINT), 1)] AS value, n
        FROM g, (SELECT CAST(unnest({_QS}) AS DOUBLE) AS q)""",
)
def group_quantiles(spark, d):
    li = table(spark, d, "lineitem").withColumn("part", F.pmod("l_suppkey", F.lit(7)))
    return ranges.group_quantiles(li, ["l_returnflag", "part"], "l_extendedprice", _QS)


@query(
    "skew_group_quantiles",
    f"""SELECT k, CAST(0.5 AS DOUBLE) AS q, quantile_disc(o_totalprice, 0.5) AS value, count(*) AS n
        FROM (SELECT {_HOT_KEY_SQL} AS k, o_totalprice FROM orders) GROUP BY k""",
)
def skew_group_quantiles(spark, d):
    """The median of each customer's orders, a third of all orders being one customer's."""
    return ranges.group_quantiles(_hot_orders(spark, d).withColumnRenamed("o_custkey", "k"), ["k"], "o_totalprice", [0.5])
