"""Row and column steps.

Names are matched case-insensitively, as the reference's rows are
case-insensitive dictionaries.  All steps are plain projections or
filters except the order-dependent ones, which take order keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.names import named as column_named
from tablesteps.operators import order as _order
from tablesteps.operators.order import OrderSpec
from tablesteps.session import ship_package


def _as_column(expr: str | Column) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


def find_column(df: DataFrame, name: str) -> str | None:
    """Actual spelling of ``name`` in ``df`` (case-insensitive), or None."""
    low = name.lower()
    for c in df.columns:
        if c.lower() == low:
            return c
    return None


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """T1 Filter/Where: keep rows where the predicate is true."""
    return df.filter(_as_column(predicate))


def project(df: DataFrame, *columns: str | Column, **named: str | Column) -> DataFrame:
    """T2 Map/Select: 1->1 projection."""
    cols = [(column_named(c) if c in df.columns else F.col(c)) if isinstance(c, str) else c for c in columns]
    cols += [_as_column(v).alias(k) for k, v in named.items()]
    return df.select(*cols)


def map_rows(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """T2 with an opaque Python function of a pandas batch (Arrow, per partition)."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


def flat_map(
    df: DataFrame, array_expr: str | Column, alias: str, keep: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """T3 SelectMany: one row per element; rows with no elements vanish.

    A fan-out multiplies rows: ``partitions`` spreads a narrow input (a
    few large files) over that many tasks first.  Only the columns the
    step uses are moved (the projection is pushed below the repartition).
    """
    if partitions:
        df = df.repartition(partitions)
    keep_cols = [column_named(c) for c in (keep if keep is not None else df.columns)]
    return df.select(*keep_cols, F.explode(_as_column(array_expr)).alias(alias))


def take(df: DataFrame, n: int, order: OrderSpec) -> DataFrame:
    """T4 Take(n): first n rows in order, planned as a top-k that ends in one
    task; for an n beyond what a task holds use ``page(df, 0, n, order)``,
    which stays distributed."""
    if n < 0:
        raise ValueError("count must be non-negative")
    return df.orderBy(*_order.sort_columns(_order.require_order(order, "take"))).limit(n)


def skip(df: DataFrame, n: int, order: OrderSpec) -> DataFrame:
    """T5 Skip(n): all rows after the first n, cut by a dense row index.

    ``orderBy().offset(n)`` alone is executed in one partition, so the
    index is used instead; the result stays distributed.
    """
    if n < 0:
        raise ValueError("count must be non-negative")
    idx = _order.with_row_index(df, order, "_skip_ri")
    return idx.filter(F.col("_skip_ri") >= n).drop("_skip_ri")


def page(df: DataFrame, offset: int, size: int, order: OrderSpec) -> DataFrame:
    """Skip(offset).Take(size) as one step: the rows of one range of the row index, sorted by it."""
    if offset < 0 or size < 0:
        raise ValueError("offset and size must be non-negative")
    idx = _order.with_row_index(df, _order.require_order(order, "page"), "_page_ri")
    return idx.filter((F.col("_page_ri") >= offset) & (F.col("_page_ri") < offset + size)).orderBy("_page_ri").drop("_page_ri")


def distinct_rows(df: DataFrame) -> DataFrame:
    """T6 Distinct by value (hash aggregate with map-side combine)."""
    return df.distinct()


def remove_duplicates(df: DataFrame, key: str | list[str], order: OrderSpec) -> DataFrame:
    """T9 RemoveDuplicates(key): first row per key; null is one key."""
    keys = [key] if isinstance(key, str) else list(key)
    resolved = []
    for k in keys:
        actual = find_column(df, k)
        if actual is None:
            raise ValueError(f"column {k!r} not found")
        resolved.append(actual)
    return _order.first_per_key(df, resolved, _order.require_order(order, "remove_duplicates"))


def fill_missing(df: DataFrame, column: str, value) -> DataFrame:
    """T10 FillMissing: replace nulls; add the column when it is absent.

    Empty text is not missing.
    """
    actual = find_column(df, column)
    lit = value if isinstance(value, Column) else F.lit(value)
    if actual is None:
        return df.withColumn(column, lit)
    return df.withColumn(actual, F.coalesce(column_named(actual), lit))


def add_column(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """T11 AddColumn: add, or overwrite in place keeping the existing spelling."""
    actual = find_column(df, name)
    return df.withColumn(actual or name, _as_column(expr))


def remove_column(df: DataFrame, name: str) -> DataFrame:
    """T12 RemoveColumn: case-insensitive; absent is a no-op."""
    low = name.lower()
    return df.select(*[column_named(c) for c in df.columns if c.lower() != low])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """T13 RenameColumn, positional.

    If ``new`` already exists the value written later wins, at the
    position (and spelling) of the column that came first.
    """
    if not old.strip() or not new.strip():
        raise ValueError("column names must not be blank")
    out_names: list[str] = []
    out_exprs: list[Column] = []
    for c in df.columns:
        target = new if c.lower() == old.lower() else c
        pos = next((i for i, n in enumerate(out_names) if n.lower() == target.lower()), None)
        if pos is None:
            out_names.append(target)
            out_exprs.append(column_named(c))
        else:
            out_exprs[pos] = column_named(c)
    return df.select(*[e.alias(n) for e, n in zip(out_exprs, out_names)])


def batch_ids(df: DataFrame, size: int, order: OrderSpec, name: str = "batch_id") -> DataFrame:
    """T14 Batch(n): rows unchanged, plus the chunk number of each row."""
    if size <= 0:
        raise ValueError("Batch size must be greater than zero")
    idx = _order.with_row_index(df, order, "_batch_ri")
    return idx.withColumn(name, F.floor(F.col("_batch_ri") / F.lit(size)).cast("long")).drop("_batch_ri")


def parallel(df: DataFrame, n: int) -> DataFrame:
    """T19 Parallel(n): spread rows over n partitions; result unchanged."""
    if n <= 0:
        raise ValueError("degree of parallelism must be positive")
    return df.repartition(n)


def row_count(df: DataFrame) -> DataFrame:
    """G5 Count() as a one-row DataFrame (the action is the caller's)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def first_row(df: DataFrame, order: OrderSpec) -> DataFrame:
    """A6/S12 First / ReadSingle: the first row in order (0 or 1 rows)."""
    return take(df, 1, order)


def scalar(df: DataFrame, column: str | Column, to_type: str, order: OrderSpec, default=None) -> DataFrame:
    """S13 ReadScalar<T>: first cell converted; null -> the type's default."""
    c = column if isinstance(column, Column) else column_named(column)
    value = c.try_cast(to_type)
    if default is not None:
        value = F.coalesce(value, F.lit(default).cast(to_type))
    return take(df, 1, order).select(value.alias("scalar"))


# --------------------------------------------------------- table row helpers
def append_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows.Add: append rows matched by column name (missing columns null)."""
    return df.unionByName(other, allowMissingColumns=True).select(*[column_named(c) for c in df.columns])


def remove_at(df: DataFrame, index: int, order: OrderSpec) -> DataFrame:
    """Rows.RemoveAt(i): drop the row at position ``i`` in order."""
    if index < 0:
        raise ValueError("index must be non-negative")
    idx = _order.with_row_index(df, order, "_rm_ri")
    return idx.filter(F.col("_rm_ri") != index).drop("_rm_ri")


def find_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows.Find(key): the rows whose key equals ``value`` (pushed to the scan)."""
    actual = find_column(df, key)
    if actual is None:
        raise ValueError(f"column {key!r} not found")
    return df.filter(column_named(actual) == F.lit(value))


def clear(df: DataFrame) -> DataFrame:
    """Rows.Clear / Clone: same columns, no rows."""
    return df.limit(0)
