"""Terminal actions (A3-A6) in their distributed form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from tablesteps.operators.order import OrderSpec, sort_columns
from tablesteps.session import ship_package


def stream_rows(df: DataFrame, order: OrderSpec | None = None) -> Iterator[Row]:
    """A3 Stream: pull rows to the caller one partition at a time
    (never the whole table at once)."""
    src = df.orderBy(*sort_columns(order)) if order else df
    return src.toLocalIterator(prefetchPartitions=True)


def for_each(df: DataFrame, fn: Callable[[Row], None]) -> None:
    """A4 ForEach: side effect per row, run on the executors (order not kept)."""

    def run(rows):
        for r in rows:
            fn(r)

    ship_package(df.sparkSession)
    df.foreachPartition(run)


def first_or_none(df: DataFrame, order: OrderSpec) -> Row | None:
    """A6 FirstOrDefault: the first row in order, or None."""
    rows = df.orderBy(*sort_columns(order)).head(1)
    return rows[0] if rows else None


def first(df: DataFrame, order: OrderSpec) -> Row:
    """A6 First: like ``first_or_none`` but an empty input is an error."""
    r = first_or_none(df, order)
    if r is None:
        raise ValueError("Sequence contains no elements")
    return r


def any_rows(df: DataFrame) -> bool:
    """X6 Any."""
    return not df.isEmpty()
