"""In-memory rows and typed objects."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def from_rows(spark: SparkSession, rows: Iterable, schema=None) -> DataFrame:
    """S27 Collection/DataRows: literal rows (tuples, dicts or Rows)."""
    return spark.createDataFrame(list(rows), schema)


def from_objects(spark: SparkSession, items: Iterable, schema=None) -> DataFrame:
    """W3 typed objects: dataclass fields become columns, in field order."""
    items = list(items)
    if items and dataclasses.is_dataclass(items[0]):
        names = [f.name for f in dataclasses.fields(items[0])]
        rows = [tuple(getattr(i, n) for n in names) for i in items]
        return spark.createDataFrame(rows, schema or names)
    return spark.createDataFrame(items, schema)
