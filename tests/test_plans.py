"""Plan shape: no single-partition exchange in order-dependent steps,
pushed filters and pruned columns in scans, partial aggregation before
shuffles; and partition independence of order-dependent steps."""

import pytest
from pyspark.sql import functions as F

from tablesteps.operators import rows as R
from tablesteps.operators.grouping import aggregate
from tablesteps.operators.order import asc, with_row_index
from tablesteps.operators.validate import Validator, validate

from conftest import SF_SMALL, rows


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def orders(spark):
    return spark.read.parquet(f"{SF_SMALL}/orders.parquet")


def test_remove_duplicates_partial_limit_no_single_partition(spark):
    df = R.remove_duplicates(orders(spark), "o_custkey", [asc("o_orderdate"), asc("o_orderkey")])
    text = plan_text(df)
    assert "SinglePartition" not in text
    assert "WindowGroupLimit" in text and "Partial" in text


def test_row_index_no_global_window(spark):
    text = executed_plan(R.batch_ids(orders(spark), 100, [asc("o_orderkey")]))
    # the only single-partition step is over per-partition counts of the written copy
    assert text.count("SinglePartition") <= 2 and "Sort [o_orderkey" not in text
    idx = with_row_index(orders(spark).select("o_orderkey"), [asc("o_orderkey")])
    assert [r.row_index for r in idx.orderBy("row_index").collect()] == list(range(orders(spark).count()))


def test_filter_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = R.filter_rows(li, (F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).select("l_orderkey")
    text = plan_text(df)
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,30.0), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text


def test_partial_aggregation(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    text = plan_text(aggregate(li, "l_returnflag", n=F.count(F.lit(1))))
    assert "partial_count" in text


def test_validation_is_one_projection_without_python(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    v = Validator().column("l_quantity").range(1, 50).column("l_returnflag").is_in(["A", "N", "R"]).validator
    text = plan_text(validate(li, v, "skip"))
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partition_independence(spark, parts):
    o = orders(spark).repartition(parts)
    base = orders(spark).coalesce(1)
    keys = [asc("o_orderdate"), asc("o_orderkey")]
    assert rows(R.remove_duplicates(o, "o_custkey", keys)) == rows(R.remove_duplicates(base, "o_custkey", keys))
    assert rows(R.batch_ids(o.select("o_orderkey"), 37, [asc("o_orderkey")])) == rows(
        R.batch_ids(base.select("o_orderkey"), 37, [asc("o_orderkey")])
    )
    assert rows(R.skip(o, 50, keys)) == rows(R.skip(base, 50, keys))
    assert [r.o_orderkey for r in R.page(o, 10, 5, keys).collect()] == [
        r.o_orderkey for r in R.page(base, 10, 5, keys).collect()
    ]
    assert rows(R.parallel(o, 3)) == rows(base)


def test_page_is_sorted_and_distributed(spark):
    o = orders(spark)
    expect = [r.o_orderkey for r in o.orderBy("o_orderkey").collect()][40:60]
    paged = R.page(o, 40, 20, [asc("o_orderkey")])
    assert "TakeOrderedAndProject" not in plan_text(paged)
    assert [r.o_orderkey for r in paged.collect()] == expect


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_row_index_does_not_rest_on_a_cache(spark, parts, coalesce):
    from tablesteps.plans.pipeline import Pipeline

    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
        df = spark.range(0, 20_000, 1, parts).selectExpr("id", "(id * 7919) % 20011 as v", "repeat('x', 20) as pad")
        idx = with_row_index(df, [asc("v"), asc("id")])
        batches = R.batch_ids(df, 1000, [asc("v"), asc("id")])
        spark.catalog.clearCache()
        Pipeline(spark.range(10), order=(asc("id"),)).skip(3).run()
        got = sorted(r.row_index for r in idx.select("*").collect())
        assert got == list(range(20_000))
        assert {r["count"] for r in batches.groupBy("batch_id").count().collect()} == {1000}
        assert R.skip(df, 1000, [asc("v"), asc("id")]).count() == 19_000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


