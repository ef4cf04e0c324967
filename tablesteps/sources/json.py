"""JSON documents and JSON Lines.

A whole document is read with ``multiLine``: a top-level array gives
one row per element, an object one row; comments are allowed.  Trailing
commas are not (Spark's parser refuses them).  ``select_path`` picks a
sub-document.  For scale prefer JSON Lines: a single large array
document is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablesteps.functions.json_path import select_path


def read_json(
    spark: SparkSession,
    path: str,
    path_expr: str | None = None,
    schema: T.StructType | str | None = None,
    mixed: bool = False,
) -> DataFrame:
    """``mixed=True`` accepts arrays that mix objects and scalars
    (scalars become empty rows): the document is parsed as a variant,
    its elements are exploded and typed JVM-side; columns then come in
    name order."""
    if mixed:
        return _read_mixed(spark, path)
    reader = spark.read.option("multiLine", "true").option("allowComments", "true").option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if path_expr:
        df = select_path(df, path_expr)
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One document per line (splittable, parallel)."""
    reader = spark.read.option("allowComments", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _read_mixed(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tablesteps.sources.rest import items_to_table

    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    elems = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    items = doc.select(F.posexplode(elems).alias("item_index", "e")).select(
        F.lit(1).cast("long").alias("page"),
        "item_index",
        F.when(F.schema_of_variant("e").startswith("OBJECT"), F.to_json("e")).otherwise(F.lit("{}")).alias("item"),
    )
    return items_to_table(items)
