"""Flagship query: validate -> add column -> group -> order -> take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.operators import grouping as G
from tablesteps.operators import rows as R
from tablesteps.operators.order import asc, desc
from tablesteps.operators.validate import Validator, validate


def flagship(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    rules = (
        Validator()
        .column("l_quantity").range(1, 50)
        .column("l_discount").range(0, 0.1)
        .column("l_returnflag").is_in(["A", "N", "R"])
        .validator
    )
    valid = validate(li, rules, "skip")
    priced = R.add_column(valid, "revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    grouped = G.aggregate(
        priced,
        ["l_returnflag", "l_linestatus"],
        n_lines=F.count(F.lit(1)),
        sum_qty=F.sum("l_quantity"),
        revenue=F.sum(F.col("revenue").cast("decimal(18,2)")).cast("decimal(38,2)"),
        avg_disc=F.avg("l_discount"),
    )
    return R.take(grouped, top, [desc("revenue"), asc("l_returnflag"), asc("l_linestatus")])
