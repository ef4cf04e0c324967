"""The six shipped templates (Q1-Q6) as steps over a people-like table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.operators import grouping as G
from tablesteps.operators import rows as R
from tablesteps.operators.order import asc


def filter_rows(df: DataFrame, predicate: str = "Age > 18") -> DataFrame:
    """Q1."""
    return R.filter_rows(df, predicate)


def sort_rows(df: DataFrame, column: str = "Name", tie_break: str = "ID") -> DataFrame:
    """Q2: ascending sort, earlier order (``tie_break``) kept for ties."""
    return df.orderBy(asc(column).column(), asc(tie_break).column())


def add_full_name(df: DataFrame, name: str = "Name", city: str = "City") -> DataFrame:
    """Q3: ``Name - City``; null reads as empty text."""
    full = F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" - "), F.coalesce(F.col(city), F.lit("")))
    return R.add_column(df, "FullName", full)


def group_by_city(df: DataFrame, key: str = "City", value: str = "Salary") -> DataFrame:
    """Q4: Count and banker's-rounded AvgSalary per city."""
    return G.aggregate(
        df, key, Count=F.count(F.lit(1)), AvgSalary=F.bround(F.avg(F.col(value)), 2).cast("decimal(18,2)")
    )


def remove_duplicate_names(df: DataFrame, key: str = "Name", order: str = "ID") -> DataFrame:
    """Q5: first row per name."""
    return R.remove_duplicates(df, key, [asc(order)])


def salary_bonus(df: DataFrame, column: str = "Salary", factor: str = "1.10") -> DataFrame:
    """Q6: value x 1.10, half-to-even at 2 decimals, in decimal arithmetic."""
    f = F.lit(factor).cast("decimal(4,2)")
    return df.withColumn(column, F.bround(F.col(column).cast("decimal(18,2)") * f, 2).cast("decimal(18,2)"))
