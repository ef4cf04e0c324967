"""SQL text with bound parameters (S10) and scalar helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def sql_query(spark: SparkSession, text: str, params: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL with named parameter markers (``:name``) bound to values.

    Values are bound as literals by the parser, never spliced into the
    text; tables are passed as ``{name}`` DataFrame references.
    """
    return spark.sql(text, args=dict(params or {}), **tables)
