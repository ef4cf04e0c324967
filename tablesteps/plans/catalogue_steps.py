"""Queries for pipelines, scripted steps, typed access and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteps.functions.json_path import path_text, select_path
from tablesteps.functions.typed import conform, failed_cells, get_value, try_get_value
from tablesteps.operators import rows as R
from tablesteps.operators.order import asc
from tablesteps.plans.catalogue import query, table
from tablesteps.plans.pipeline import Pipeline
from tablesteps.sources.documents import find
from tablesteps.sources.sql import sql_query


# ---------------------------------------------------------------- A8
@query(
    "declarative_steps",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n_orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
       FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def declarative_steps(spark, d):
    p = (
        Pipeline(table(spark, d, "orders"), source_name="orders")
        .filter("o_orderstatus = 'F'", title="finished orders")
        .add_column("o_year", F.year("o_orderdate"))
        .group_by(
            "o_year",
            n_orders=F.count(F.lit(1)),
            total=F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)"),
        )
        .sort([asc("o_year")])
    )
    return p.plan()


# ---------------------------------------------------------------- A9
_SCRIPT = """-- order value per priority
SELECT o_orderpriority, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM {data} GROUP BY o_orderpriority"""


@query("scripted_sql_step", _SCRIPT.replace("{data}", "orders"))
def scripted_sql_step(spark, d):
    return Pipeline(table(spark, d, "orders")).code(_SCRIPT, title="priority totals").plan()


# ---------------------------------------------------------------- S10
@query(
    "sql_with_args",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000.0",
)
def sql_with_args(spark, d):
    return sql_query(
        spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :min_price",
        {"status": "O", "min_price": 100000.0},
        orders=table(spark, d, "orders"),
    )


# ---------------------------------------------------------------- T15
@query(
    "typed_access",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k_or_zero
       FROM events""",
)
def typed_access(spark, d):
    ev = table(spark, d, "events")
    k_text = path_text("props", "$.k")
    return ev.select("event_id", try_get_value(k_text, "int").alias("k"), get_value(k_text.try_cast("int"), "int").alias("k_or_zero"))


# ---------------------------------------------------------------- T16
def _events_as_text(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        "event_id",
        F.col("value").cast("string").alias("value"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
    )


_CONFORM = {"value": "double", "user_id": "int", "event_type": "boolean"}


@query(
    "conform_types",
    """SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value,
              TRY_CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS user_id,
              CASE WHEN lower(trim(event_type)) IN ('true', '1') THEN true
                   WHEN lower(trim(event_type)) IN ('false', '0') THEN false END AS event_type
       FROM events""",
)
def conform_types(spark, d):
    return conform(_events_as_text(spark, d), _CONFORM)


@query(
    "conform_report",
    """SELECT CAST(count_if(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NULL) AS BIGINT) AS value,
              CAST(count_if(TRY_CAST(CAST(user_id AS VARCHAR) AS INTEGER) IS NULL) AS BIGINT) AS user_id,
              CAST(count_if(lower(trim(event_type)) NOT IN ('true', '1', 'false', '0')) AS BIGINT) AS event_type
       FROM events""",
)
def conform_report(spark, d):
    return failed_cells(_events_as_text(spark, d), _CONFORM)


# ---------------------------------------------------------------- S6
@query(
    "json_select_path",
    "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
)
def json_select_path(spark, d):
    ev = table(spark, d, "events").select(F.from_json("props", "k int").alias("props"))
    return select_path(ev, "$.props.k", "k")


# ---------------------------------------------------------------- S15
@query(
    "doc_find",
    """SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
       ORDER BY conv_id DESC, turn LIMIT 20 OFFSET 10""",
)
def doc_find(spark, d):
    conv = table(spark, d, "conversations")
    return find(
        conv,
        where={"role": "user"},
        sort=("conv_id", -1),
        skip=10,
        limit=20,
        project=["conv_id", "turn", "text"],
        id_fields=("turn",),
    )


# ---------------------------------------------------------------- T19
@query("parallel_rows", "SELECT * FROM orders")
def parallel_rows(spark, d):
    return R.parallel(table(spark, d, "orders"), 7)


# ---------------------------------------------------------------- T7 T8 T4 via the pipeline
@query(
    "pipeline_order_take",
    """SELECT * FROM orders
       ORDER BY o_totalprice DESC NULLS LAST, o_orderpriority ASC NULLS FIRST, o_orderkey LIMIT 30""",
)
def pipeline_order_take(spark, d):
    p = (
        Pipeline(table(spark, d, "orders"), source_name="orders", order=(asc("o_orderkey"),))
        .order_by("o_orderpriority")
        .order_by_desc("o_totalprice")
        .take(30)
    )
    return p.plan()


@query(
    "pipeline_keep_first",
    """SELECT * FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) = 1""",
)
def pipeline_keep_first(spark, d):
    p = (
        Pipeline(table(spark, d, "customer"), source_name="customer", order=(asc("c_custkey"),))
        .order_by_desc("c_acctbal")
        .remove_duplicates("c_nationkey")
    )
    return p.plan()


# ---------------------------------------------------------------- X4
@query(
    "row_helpers",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS note FROM orders
       WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)
       UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer""",
)
def row_helpers(spark, d):
    """Rows.Add from another table (by name), then RemoveAt(0)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    left = R.remove_at(o.withColumn("note", F.lit(None).cast("string")), 0, [asc("o_orderkey")])
    more = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return R.append_rows(left, more)


# ---------------------------------------------------------------- V13
@query(
    "validate_throw",
    """SELECT *, CAST(0 AS BIGINT) AS refused FROM orders
       UNION ALL SELECT NULL, NULL, o_orderstatus, NULL, NULL, NULL, count(*) FROM orders
       WHERE (SELECT min(o_totalprice) FROM orders) < 100000 GROUP BY o_orderstatus""",
)
def validate_throw(spark, d):
    """Rows that keep the rules pass, all of them; a rule that some row breaks fails the job, which is caught and told
    with the number of rows of each status that it refused to hand on."""
    from tablesteps.operators.validate import Validator, validate

    o = table(spark, d, "orders")
    sound = Validator().column("o_orderkey").required().column("o_totalprice").range(0, 1e9).validator
    strict = Validator().column("o_orderkey").required().column("o_totalprice").range(100_000, 1e9).validator
    out = validate(o, sound, "throw").withColumn("refused", F.lit(0).cast("long"))
    try:
        validate(o, strict, "throw").write.format("noop").mode("overwrite").save()
        return out
    except Exception as e:  # noqa: BLE001 - the engine wraps the error of the rule
        if "Value must be between" not in str(e):
            raise
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "o_orderstatus" else F.col(f.name) for f in o.schema.fields]
    return out.unionAll(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("refused")).select(*nothing, "refused"))


@query(
    "table_changes",
    """WITH b AS (SELECT * REPLACE (CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN l_tax + 1 ELSE l_tax END AS l_tax) FROM lineitem
                  WHERE NOT (l_quantity = 1 AND l_linenumber = 7)
                  UNION ALL SELECT * FROM lineitem WHERE l_quantity = 2 AND l_linenumber = 7)
       SELECT 'left' AS side, count(*) AS surplus, * FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM b) GROUP BY ALL
       UNION ALL
       SELECT 'right' AS side, count(*) AS surplus, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM lineitem) GROUP BY ALL""",
)
def table_changes(spark, d):
    """Changed, missing and doubled rows between two copies of a whole table are named; equal parts never move."""
    from tablesteps.operators.digests import differing_rows

    a = table(spark, d, "lineitem")
    last = F.col("l_linenumber") == 7
    changed = F.when(last & (F.col("l_quantity") == 50), F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    b = a.filter(~(last & (F.col("l_quantity") == 1))).withColumn("l_tax", changed)
    b = b.unionAll(a.filter(last & (F.col("l_quantity") == 2)))
    return differing_rows(a, b, ["l_orderkey"])
