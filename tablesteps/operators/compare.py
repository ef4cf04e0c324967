"""Table equivalence (T17) and table comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.names import named
from tablesteps.operators.order import OrderSpec, with_row_index


def _same_shape(a: DataFrame, b: DataFrame) -> bool:
    return len(a.columns) == len(b.columns) and all(
        x.lower() == y.lower() for x, y in zip(a.columns, b.columns)
    )


def difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset comparison in one shuffle.

    Both tables are tagged and grouped by the whole row (nulls group
    together, so they compare equal); per distinct row the surplus on
    either side is counted.  Partial aggregation collapses repeated rows
    map-side, and nothing is collected.
    """
    if not _same_shape(a, b):
        raise ValueError("tables differ in width or column names")
    cols = a.columns
    quoted_cols = [named(c) for c in cols]
    b2 = b.toDF(*cols)
    tagged = a.select(*quoted_cols, F.lit(1).alias("_in_a"), F.lit(0).alias("_in_b")).unionByName(
        b2.select(*quoted_cols, F.lit(0).alias("_in_a"), F.lit(1).alias("_in_b"))
    )
    per_row = tagged.groupBy(*quoted_cols).agg(F.sum("_in_a").alias("_na"), F.sum("_in_b").alias("_nb"))
    out = per_row.agg(
        F.coalesce(F.sum("_na"), F.lit(0)).cast("long").alias("rows_left"),
        F.coalesce(F.sum("_nb"), F.lit(0)).cast("long").alias("rows_right"),
        F.coalesce(F.sum(F.greatest(F.col("_na") - F.col("_nb"), F.lit(0))), F.lit(0)).cast("long").alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("_nb") - F.col("_na"), F.lit(0))), F.lit(0)).cast("long").alias("only_right"),
    )
    return out.withColumn(
        "equivalent",
        (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("rows_left") == F.col("rows_right")),
    )


def ordered_difference(a: DataFrame, b: DataFrame, order_a: OrderSpec, order_b: OrderSpec) -> DataFrame:
    """The reference's in-order form: row i of ``a`` equals row i of ``b``.

    Nulls compare equal.  Returns one row: rows compared and rows differing.
    """
    if not _same_shape(a, b):
        raise ValueError("tables differ in width or column names")
    ia = with_row_index(a, order_a, "_ri").select("_ri", F.struct(*[named(c) for c in a.columns]).alias("_ra"))
    ib = with_row_index(b.toDF(*a.columns), order_b, "_ri").select("_ri", F.struct(*[named(c) for c in a.columns]).alias("_rb"))
    j = ia.join(ib, "_ri", "full_outer")
    return j.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.count_if(~F.col("_ra").eqNullSafe(F.col("_rb"))).alias("rows_differing"),
    )


def tables_equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Convenience action: True when both tables hold the same rows."""
    if not _same_shape(a, b):
        return False
    return bool(difference_counts(a, b).first()["equivalent"])
