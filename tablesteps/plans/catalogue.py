"""The query catalogue: one Spark query per operator, each with the
DuckDB SQL that must give the same rows.

Every query reads the driver's tables (or tables Spark derives from
them) in full, so its work grows with the scale factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.operators import grouping as G
from tablesteps.operators import rows as R
from tablesteps.operators import upsert as U
from tablesteps.operators.compare import difference_counts
from tablesteps.operators.join import join_step
from tablesteps.operators.order import asc, chain, desc, with_row_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- T1 Q1
@query("filter_rows", "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_rows(spark, d):
    return R.filter_rows(table(spark, d, "lineitem"), (F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R"))


# ---------------------------------------------------------------- T2
@query(
    "map_project",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_year,
              o_totalprice * CAST(1.1 AS DOUBLE) AS price_with_tax
       FROM orders""",
)
def map_project(spark, d):
    return R.project(
        table(spark, d, "orders"),
        "o_orderkey",
        o_year=F.year("o_orderdate"),
        price_with_tax=F.col("o_totalprice") * F.lit(1.1),
    )


# ---------------------------------------------------------------- T3
@query(
    "flat_map_tokens",
    """SELECT token, count(*) AS n
       FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
       WHERE token <> '' GROUP BY token""",
)
def flat_map_tokens(spark, d):
    docs = table(spark, d, "documents")
    cores = spark.sparkContext.defaultParallelism  # a few files of documents hold many tokens
    tokens = R.flat_map(docs, F.split("text", " "), "token", keep=[], partitions=cores)
    return G.aggregate(tokens.filter(F.col("token") != ""), "token", n=F.count(F.lit(1)))


# ---------------------------------------------------------------- T4 T8
@query("take_top", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def take_top(spark, d):
    return R.take(table(spark, d, "orders"), 25, [desc("o_totalprice"), asc("o_orderkey")])


# ---------------------------------------------------------------- T5 T4
@query("skip_take_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def skip_take_page(spark, d):
    return R.page(table(spark, d, "orders"), 100, 50, [asc("o_orderkey")])


@query("skip_rows", "SELECT * FROM orders ORDER BY o_orderkey OFFSET 1000")
def skip_rows(spark, d):
    return R.skip(table(spark, d, "orders"), 1000, [asc("o_orderkey")])


# ---------------------------------------------------------------- T6
@query("distinct_rows", "SELECT DISTINCT * FROM orders")
def distinct_rows(spark, d):
    """Whole rows; every order of high value stands twice."""
    orders = table(spark, d, "orders")
    return R.distinct_rows(orders.unionByName(orders.filter(F.col("o_totalprice") > 100_000)))


# ---------------------------------------------------------------- T7 Q2
@query(
    "order_by_chain",
    """SELECT c_custkey, c_nationkey, c_mktsegment,
              row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) - 1 AS row_index
       FROM customer""",
)
def order_by_chain(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # arrival order c_custkey; OrderBy(segment) then OrderBy(nation)
    keys = chain(chain([asc("c_custkey")], [asc("c_mktsegment")]), [asc("c_nationkey")])
    return with_row_index(cust, keys)


# ---------------------------------------------------------------- T8
@query(
    "order_by_desc",
    """SELECT p_partkey, nullif(p_size, 1) AS size_key,
              row_number() OVER (ORDER BY nullif(p_size, 1) DESC NULLS LAST, p_partkey) - 1 AS row_index
       FROM part""",
)
def order_by_desc(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size_key"))
    return with_row_index(part, [desc("size_key"), asc("p_partkey")])


# ---------------------------------------------------------------- T9 G4 Q5
@query(
    "remove_duplicates",
    """SELECT * FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def remove_duplicates(spark, d):
    return R.remove_duplicates(table(spark, d, "orders"), "o_custkey", [asc("o_orderdate"), asc("o_orderkey")])


# ---------------------------------------------------------------- T10
@query(
    "fill_missing",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, false AS reviewed
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    labels = table(spark, d, "labels")
    joined = join_step(docs, labels, ["doc_id"], "left")
    out = R.fill_missing(joined, "quality", -1)
    out = R.fill_missing(out, "toxic", 0)
    return R.fill_missing(out, "reviewed", False)


# ---------------------------------------------------------------- T11 Q3
@query(
    "add_column",
    """SELECT c_custkey, c_name, c_mktsegment,
              coalesce(c_name, '') || ' - ' || coalesce(c_mktsegment, '') AS c_label
       FROM customer""",
)
def add_column(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    label = F.concat(F.coalesce("c_name", F.lit("")), F.lit(" - "), F.coalesce("c_mktsegment", F.lit("")))
    return R.add_column(cust, "c_label", label)


# ---------------------------------------------------------------- T12
@query("remove_column", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def remove_column(spark, d):
    return R.remove_column(table(spark, d, "part"), "P_TYPE")


# ---------------------------------------------------------------- T13
@query(
    "rename_column",
    "SELECT p_partkey, p_name AS p_title, p_type AS p_brand, p_size, p_retailprice FROM part",
)
def rename_column(spark, d):
    part = R.rename_column(table(spark, d, "part"), "p_name", "p_title")
    # collision: p_type renamed onto p_brand -> p_type's value wins at p_brand's place
    return R.rename_column(part, "P_TYPE", "p_brand")


# ---------------------------------------------------------------- T14
@query(
    "batch_ids",
    """SELECT batch_id, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
       FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id FROM orders)
       GROUP BY batch_id""",
)
def batch_ids(spark, d):
    b = R.batch_ids(table(spark, d, "orders").select("o_orderkey"), 1000, [asc("o_orderkey")])
    return G.aggregate(
        b,
        "batch_id",
        n_rows=F.count(F.lit(1)),
        first_key=F.min("o_orderkey"),
        last_key=F.max("o_orderkey"),
    )


# ---------------------------------------------------------------- G1
@query(
    "group_members",
    """SELECT c_mktsegment AS group_key,
              row_number() OVER (ORDER BY min(c_custkey)) - 1 AS group_index,
              count(*) AS n_members, min(c_custkey) AS first_custkey
       FROM customer GROUP BY c_mktsegment""",
)
def group_members(spark, d):
    cust = table(spark, d, "customer")
    return G.group_summary(
        cust,
        "c_mktsegment",
        [asc("c_custkey")],
        n_members=F.count(F.lit(1)),
        first_custkey=F.min("c_custkey"),
    )


@query(
    "group_rows_tagged",
    """SELECT o_orderkey, o_orderpriority AS group_key,
              dense_rank() OVER (ORDER BY first_date, first_key) - 1 AS group_index
       FROM (SELECT o_orderkey, o_orderpriority,
                    min(o_orderdate) OVER (PARTITION BY o_orderpriority) AS first_date,
                    arg_min(o_orderkey, struct_pack(o_orderdate, o_orderkey)) OVER (PARTITION BY o_orderpriority) AS first_key
             FROM orders)""",
)
def group_rows_tagged(spark, d):
    """G1 at row level: every order with its group's first-seen index."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    g = G.group_rows(o, "o_orderpriority", [asc("o_orderdate"), asc("o_orderkey")])
    return g.select("o_orderkey", "group_key", "group_index")


# ---------------------------------------------------------------- G2
@query(
    "group_aggregate",
    """SELECT l_returnflag, l_linestatus,
              sum(l_quantity) AS sum_qty,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_base_price,
              min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
              count(*) AS count_order
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_aggregate(spark, d):
    li = table(spark, d, "lineitem")
    return G.aggregate(
        li,
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.sum("l_quantity"),
        sum_base_price=F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)"),
        min_price=F.min("l_extendedprice"),
        max_price=F.max("l_extendedprice"),
        count_order=F.count(F.lit(1)),
    )


def _range_partial(pdf):
    import pandas as pd

    v = pdf["l_extendedprice"]
    return pd.DataFrame({"l_returnflag": [pdf["l_returnflag"].iloc[0]], "lo": [v.min()], "hi": [v.max()]})


def _range_combine(pdf):
    import pandas as pd

    return pd.DataFrame({"l_returnflag": [pdf["l_returnflag"].iloc[0]], "lo": [pdf["lo"].min()], "hi": [pdf["hi"].max()]})


def _range_merge(pdf):
    import pandas as pd

    return pd.DataFrame(
        {"l_returnflag": [pdf["l_returnflag"].iloc[0]], "price_range": [pdf["hi"].max() - pdf["lo"].min()]}
    )


@query(
    "group_custom_agg",
    "SELECT l_returnflag, max(l_extendedprice) - min(l_extendedprice) AS price_range FROM lineitem GROUP BY l_returnflag",
)
def group_custom_agg(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return G.custom_aggregate(
        li,
        ["l_returnflag"],
        _range_partial,
        "l_returnflag string, lo double, hi double",
        _range_merge,
        "l_returnflag string, price_range double",
        combine=_range_combine,
    )


# ---------------------------------------------------------------- G3 Q4
# Exact banker's rounding of the average in DuckDB: integer cents, then
# half-to-even on the remainder (DuckDB divides decimals in DOUBLE).
_BANKERS_AVG = """
WITH s AS (
  SELECT c_mktsegment, count(*) AS n,
         CAST(sum(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS HUGEINT)) AS HUGEINT) AS cents
  FROM customer GROUP BY c_mktsegment),
q AS (SELECT c_mktsegment, n, cents, CAST(floor(cents / n) AS HUGEINT) AS fq FROM s),
r AS (SELECT c_mktsegment, n, fq, cents - fq * n AS rem FROM q)
SELECT c_mktsegment, n,
       CAST(CAST(CASE WHEN 2 * rem > n THEN fq + 1
                      WHEN 2 * rem < n THEN fq
                      WHEN fq % 2 = 0 THEN fq ELSE fq + 1 END AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2))
            AS DECIMAL(18,2)) AS avg_acctbal
FROM r
"""


@query("group_count_avg", _BANKERS_AVG)
def group_count_avg(spark, d):
    cust = table(spark, d, "customer")
    return G.aggregate(
        cust,
        "c_mktsegment",
        n=F.count(F.lit(1)),
        avg_acctbal=F.bround(F.avg(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("decimal(18,2)"),
    )


# ---------------------------------------------------------------- Q6
@query(
    "convert_types",
    """SELECT c_custkey,
              CAST(round_even(CAST(c_acctbal AS DECIMAL(18,2)) * CAST(1.10 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))
                AS bonus_acctbal
       FROM customer""",
)
def convert_types(spark, d):
    cust = table(spark, d, "customer")
    bonus = F.bround(F.col("c_acctbal").cast("decimal(18,2)") * F.lit(1.10).cast("decimal(3,2)"), 2)
    return cust.select("c_custkey", bonus.cast("decimal(18,2)").alias("bonus_acctbal"))


# ---------------------------------------------------------------- G5 A6 S12 S13
@query("row_count", "SELECT count(*) AS row_count FROM orders")
def row_count(spark, d):
    return R.row_count(table(spark, d, "orders"))


@query("first_row", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_row(spark, d):
    return R.first_row(table(spark, d, "orders"), [asc("o_orderdate"), asc("o_orderkey")])


@query(
    "scalar_result",
    "SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS scalar FROM orders ORDER BY o_orderkey LIMIT 1",
)
def scalar_result(spark, d):
    return R.scalar(table(spark, d, "orders"), "o_totalprice", "decimal(18,2)", [asc("o_orderkey")])


# ---------------------------------------------------------------- T17
@query(
    "tables_equivalent",
    """WITH a AS (SELECT * FROM orders),
            b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
                         CASE WHEN o_orderstatus = 'P' THEN lower(o_orderpriority) ELSE o_orderpriority END
                           AS o_orderpriority
                  FROM orders)
       SELECT (SELECT count(*) FROM a) AS rows_left, (SELECT count(*) FROM b) AS rows_right,
              (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left,
              (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right,
              (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0
                AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0
                AND (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS equivalent""",
)
def tables_equivalent(spark, d):
    a = table(spark, d, "orders")
    b = a.withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")),
    )
    return difference_counts(a, b)


# ---------------------------------------------------------------- A8 join
@query(
    "join_step",
    """SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, o.o_totalprice
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def join_inner(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = join_step(o, c, [("o_custkey", "c_custkey")], "inner")
    return j.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice")


@query(
    "join_anti",
    """SELECT c.* FROM customer c WHERE NOT EXISTS
       (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
)
def join_anti(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return join_step(c, o, [("c_custkey", "o_custkey")], "anti")


# ---------------------------------------------------------------- upserts
_UPSERT_CTE = """
t AS (SELECT * FROM customer WHERE c_nationkey < 15),
s AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, 1 AS src_seq FROM customer WHERE c_nationkey >= 10
      UNION ALL
      SELECT c_custkey, c_acctbal + 2 AS c_acctbal, 2 AS src_seq FROM customer
      WHERE c_nationkey >= 10 AND c_mktsegment = 'BUILDING')
"""


def _upsert_inputs(spark, d):
    cust = table(spark, d, "customer")
    target = cust.filter(F.col("c_nationkey") < 15)
    src1 = cust.filter(F.col("c_nationkey") >= 10).select(
        "c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("src_seq")
    )
    src2 = cust.filter((F.col("c_nationkey") >= 10) & (F.col("c_mktsegment") == "BUILDING")).select(
        "c_custkey", (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit(2).alias("src_seq")
    )
    return target, src1.unionByName(src2)


@query(
    "upsert_do_nothing",
    f"""WITH {_UPSERT_CTE},
    first AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq) = 1)
    SELECT * FROM t
    UNION ALL
    SELECT f.c_custkey, NULL AS c_name, NULL AS c_nationkey, f.c_acctbal, NULL AS c_mktsegment
    FROM first f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c_custkey = f.c_custkey)""",
)
def upsert_do_nothing(spark, d):
    target, source = _upsert_inputs(spark, d)
    return U.upsert_do_nothing(target, source, ["c_custkey"], [asc("src_seq")])


@query(
    "upsert_update",
    f"""WITH {_UPSERT_CTE},
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq DESC) = 1)
    SELECT coalesce(t.c_custkey, l.c_custkey) AS c_custkey, t.c_name, t.c_nationkey,
           CASE WHEN l.c_custkey IS NOT NULL THEN l.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
           t.c_mktsegment
    FROM t FULL OUTER JOIN last l ON t.c_custkey = l.c_custkey""",
)
def upsert_update(spark, d):
    target, source = _upsert_inputs(spark, d)
    return U.upsert_update(target, source, ["c_custkey"], [asc("src_seq")])


@query(
    "upsert_replace",
    f"""WITH {_UPSERT_CTE},
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq DESC) = 1)
    SELECT t.*, CAST(NULL AS INTEGER) AS src_seq FROM t
    WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.c_custkey = t.c_custkey)
    UNION ALL
    SELECT c_custkey, NULL AS c_name, NULL AS c_nationkey, c_acctbal, NULL AS c_mktsegment, src_seq FROM last""",
)
def upsert_replace(spark, d):
    target, source = _upsert_inputs(spark, d)
    return U.upsert_replace(target, source, "c_custkey", [asc("src_seq")])


@query(
    "upsert_predicate",
    f"""WITH {_UPSERT_CTE},
    w AS (SELECT * FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.c_custkey = s.c_custkey)
          QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq DESC) = 1)
    SELECT CASE WHEN w.c_custkey IS NOT NULL THEN w.c_custkey ELSE t.c_custkey END AS c_custkey,
           t.c_name, t.c_nationkey,
           CASE WHEN w.c_custkey IS NOT NULL THEN w.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
           t.c_mktsegment
    FROM t LEFT JOIN w ON t.c_custkey = w.c_custkey
    UNION ALL
    SELECT c_custkey, NULL, NULL, c_acctbal, NULL FROM s
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c_custkey = s.c_custkey)
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq DESC) = 1""",
)
def upsert_predicate(spark, d):
    target, source = _upsert_inputs(spark, d)
    return U.upsert_predicate(
        target, source, [("c_custkey", "c_custkey")], [asc("c_custkey")], [asc("src_seq"), asc("c_custkey")]
    )


_EXTRA_MODULES = (
    "tablesteps.plans.catalogue_ranges",
    "tablesteps.plans.catalogue_validate",
    "tablesteps.plans.catalogue_steps",
    "tablesteps.plans.catalogue_io",
)


def load_all() -> None:
    """Import the catalogue parts that register further queries."""
    import importlib

    for m in _EXTRA_MODULES:
        importlib.import_module(m)


# ---------------------------------------------------------------- more coverage
@query(
    "tables_equivalent_ordered",
    """WITH a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
            b AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                         CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END
                           AS o_totalprice,
                         o_orderdate, o_orderpriority,
                         row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
       SELECT count(*) AS rows_compared,
              CAST(count_if(a.o_orderkey IS DISTINCT FROM b.o_orderkey OR a.o_custkey IS DISTINCT FROM b.o_custkey
                            OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
                            OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
                            OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
                            OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority) AS BIGINT) AS rows_differing
       FROM a FULL OUTER JOIN b ON a.rn = b.rn""",
)
def tables_equivalent_ordered(spark, d):
    from tablesteps.operators.compare import ordered_difference

    a = table(spark, d, "orders")
    b = a.withColumn(
        "o_totalprice",
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    )
    return ordered_difference(a, b, [asc("o_orderkey")], [asc("o_orderkey")])


def _price_band(pdf):
    out = pdf[["o_orderkey"]].copy()
    out["price_band"] = (pdf["o_totalprice"] // 100000).astype("int32")
    return out


@query(
    "map_opaque",
    "SELECT o_orderkey, CAST(floor(o_totalprice / 100000) AS INTEGER) AS price_band FROM orders",
)
def map_opaque(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.map_rows(o, _price_band, "o_orderkey long, price_band int")


@query(
    "join_semi",
    """SELECT c.* FROM customer c WHERE EXISTS
       (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
)
def join_semi(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return join_step(c, o, [("c_custkey", "o_custkey")], "semi")


@query(
    "upsert_null_keys",
    """WITH t AS (SELECT * FROM customer WHERE c_nationkey < 15),
    s AS (SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_custkey END AS c_custkey,
                 c_acctbal + 1 AS c_acctbal, 1 AS src_seq
          FROM customer WHERE c_nationkey >= 10),
    last AS (SELECT * FROM s WHERE c_custkey IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src_seq DESC) = 1)
    SELECT coalesce(t.c_custkey, l.c_custkey) AS c_custkey, t.c_name, t.c_nationkey,
           CASE WHEN l.c_custkey IS NOT NULL THEN l.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
           t.c_mktsegment
    FROM t FULL OUTER JOIN last l ON t.c_custkey = l.c_custkey
    UNION ALL
    SELECT NULL, NULL, NULL, c_acctbal, NULL FROM s WHERE c_custkey IS NULL""",
)
def upsert_null_keys(spark, d):
    cust = table(spark, d, "customer")
    target = cust.filter(F.col("c_nationkey") < 15)
    key = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None).cast("long")).otherwise(F.col("c_custkey"))
    source = cust.filter(F.col("c_nationkey") >= 10).select(
        key.alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("src_seq")
    )
    return U.upsert_update(target, source, ["c_custkey"], [asc("src_seq")])


# ---------------------------------------------------------------- hot keys
# About a third of orders are finished ('F'); mapping all of them to one
# customer key makes that key hold a third of the rows.
_HOT_KEY_SQL = "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END"


def _hot_orders(spark, d):
    o = table(spark, d, "orders")
    hot = F.when(F.col("o_orderstatus") == "F", F.lit(0).cast("long")).otherwise(F.col("o_custkey"))
    return o.withColumn("o_custkey", hot)


@query(
    "skew_remove_duplicates",
    f"""SELECT o_orderkey, {_HOT_KEY_SQL} AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders
        QUALIFY row_number() OVER (PARTITION BY {_HOT_KEY_SQL} ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def skew_remove_duplicates(spark, d):
    return R.remove_duplicates(_hot_orders(spark, d), "o_custkey", [desc("o_orderdate"), asc("o_orderkey")])


def _spread_partial(pdf):
    g = pdf.groupby("o_custkey", sort=False, dropna=False)["o_totalprice"]
    return g.agg(lo="min", hi="max", n="count").reset_index()


def _spread_combine(pdf):
    return pdf.groupby("o_custkey", sort=False, dropna=False).agg(lo=("lo", "min"), hi=("hi", "max"), n=("n", "sum")).reset_index()


def _spread_merge(pdf):
    c = _spread_combine(pdf)
    return c.assign(price_spread=c["hi"] - c["lo"], n_orders=c["n"].astype("int64"))[
        ["o_custkey", "price_spread", "n_orders"]
    ]


@query(
    "skew_custom_agg",
    f"""SELECT {_HOT_KEY_SQL} AS o_custkey, max(o_totalprice) - min(o_totalprice) AS price_spread,
               count(*) AS n_orders
        FROM orders GROUP BY 1""",
)
def skew_custom_agg(spark, d):
    o = _hot_orders(spark, d).select("o_custkey", "o_totalprice")
    return G.custom_aggregate(
        o,
        ["o_custkey"],
        _spread_partial,
        "o_custkey long, lo double, hi double, n long",
        _spread_merge,
        "o_custkey long, price_spread double, n_orders long",
        combine=_spread_combine,
        vectorized=True,
    )


@query(
    "skew_upsert_update",
    f"""WITH t AS (SELECT c_custkey, c_name, c_acctbal FROM customer),
    s AS (SELECT {_HOT_KEY_SQL} AS c_custkey, o_totalprice AS c_acctbal, o_orderdate, o_orderkey FROM orders),
    last AS (SELECT * FROM s
             QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT coalesce(t.c_custkey, l.c_custkey) AS c_custkey, t.c_name,
           CASE WHEN l.c_custkey IS NOT NULL THEN l.c_acctbal ELSE t.c_acctbal END AS c_acctbal
    FROM t FULL OUTER JOIN last l ON t.c_custkey = l.c_custkey""",
)
def skew_upsert_update(spark, d):
    """Latest order total per customer written onto the customer table;
    the hot key's third of the source collapses map-side first."""
    target = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = _hot_orders(spark, d).select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey"
    )
    return U.upsert_update(target, source, ["c_custkey"], [asc("o_orderdate"), asc("o_orderkey")])


@query(
    "skew_join_step",
    f"""SELECT o.o_orderkey, c.c_custkey, c.c_name, o.o_totalprice
        FROM (SELECT o_orderkey, {_HOT_KEY_SQL} AS o_custkey, o_totalprice FROM orders) o
        JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def skew_join_step(spark, d):
    """A third of the orders meet one customer: a broadcast when the
    customer side is measured small, else a sort-merge join whose hot
    partition AQE splits."""
    o = _hot_orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    j = join_step(o, c, [("o_custkey", "c_custkey")], "inner")
    return j.select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query(
    "skew_upsert_predicate",
    f"""WITH t AS (SELECT o_orderkey, {_HOT_KEY_SQL} AS k, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'),
    s AS (SELECT o_orderkey, {_HOT_KEY_SQL} AS k, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'),
    one AS (SELECT min(o_orderkey) AS o_orderkey, k FROM t GROUP BY k),
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1)
    SELECT t.o_orderkey, t.k, CASE WHEN l.k IS NOT NULL THEN l.o_totalprice ELSE t.o_totalprice END AS o_totalprice
    FROM t LEFT JOIN one ON t.o_orderkey = one.o_orderkey LEFT JOIN last l ON one.k = l.k
    UNION ALL
    SELECT NULL, k, o_totalprice FROM last WHERE k NOT IN (SELECT k FROM t)""",
)
def skew_upsert_predicate(spark, d):
    """A third of the rows of both sides share one key: one target row is updated, no pairs are made.  All orders but
    the urgent ones are the target, all but the low ones the source; every order is in one of them."""
    o = _hot_orders(spark, d).withColumnRenamed("o_custkey", "k")
    target = o.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "k", "o_totalprice")
    source = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("src_key"), "k", "o_totalprice")
    return U.upsert_predicate(target, source, [("k", "k")], [asc("o_orderkey")], [asc("src_key")])


@query(
    "skew_upsert_condition",
    f"""WITH t AS (SELECT o_orderkey, {_HOT_KEY_SQL} AS k, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority <> '1-URGENT'),
    s AS (SELECT o_orderkey AS src_key, {_HOT_KEY_SQL} AS k, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority <> '5-LOW'),
    m AS (SELECT s.src_key, min(t.o_orderkey) AS o_orderkey FROM s JOIN t
          ON s.k = t.k AND t.o_orderdate > s.o_orderdate AND t.o_totalprice >= s.o_totalprice GROUP BY s.src_key),
    w AS (SELECT o_orderkey, max(src_key) AS src_key FROM m GROUP BY o_orderkey)
    SELECT t.o_orderkey, t.k, CASE WHEN w.src_key IS NULL THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
           CASE WHEN w.src_key IS NULL THEN t.o_orderdate ELSE s.o_orderdate END AS o_orderdate
    FROM t LEFT JOIN w ON t.o_orderkey = w.o_orderkey LEFT JOIN s ON s.src_key = w.src_key
    UNION ALL
    SELECT NULL, k, o_totalprice, o_orderdate FROM s WHERE src_key NOT IN (SELECT src_key FROM m)""",
)
def skew_upsert_condition(spark, d):
    """The sides of ``skew_upsert_predicate``; a row updates the first order of its key that is later and not cheaper."""
    o = _hot_orders(spark, d).withColumnRenamed("o_custkey", "k")
    target = o.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "k", "o_totalprice", "o_orderdate")
    source = o.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("src_key"), "k", "o_totalprice", "o_orderdate"
    )
    later = [("o_orderdate", ">", "o_orderdate"), ("o_totalprice", ">=", "o_totalprice")]
    return U.upsert_predicate(target, source, [("k", "k")], [asc("o_orderkey")], [asc("src_key")], later)
