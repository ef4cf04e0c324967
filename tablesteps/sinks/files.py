"""CSV and JSON sinks.

Output is a directory of part files, written by the executors in
parallel (one file per partition); each part has its own header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.names import named

# The reference's text forms.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def write_csv(
    df: DataFrame,
    path: str,
    delimiter: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    quote_all: bool = False,
    append: bool = False,
    files: int | None = None,
) -> None:
    """RFC quoting when needed, ``yyyy-MM-dd HH:mm:ss``, lower-case
    booleans, null as empty.  Append writes new part files, each with its
    own header, without touching the existing ones.  ``files`` deals the rows
    over that many files.
    """
    if files:
        # hash of the whole row: deterministic on task retry without the
        # sort a round-robin repartition needs; only identical rows share a file
        df = df.repartition(files, *[named(c) for c in df.columns])
    (
        df.write.mode("append" if append else "overwrite")
        .option("sep", delimiter)
        .option("header", "true" if header else "false")
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", "true" if quote_all else "false")
        .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = True, camel_case: bool = False, append: bool = False) -> None:
    """W4 as JSON Lines; nulls kept by default; optional camel-case keys."""
    out = df
    if camel_case:
        out = df.select(*[named(c).alias(c[:1].lower() + c[1:]) for c in df.columns])
    (
        out.write.mode("append" if append else "overwrite")
        .option("ignoreNullFields", "false" if keep_nulls else "true")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
        .json(path)
    )


def write_json_object(df: DataFrame, path: str, order=None) -> None:
    """W5 WriteObject: one row (the first in ``order`` when given) as one
    JSON object file; a bounded top-1, never the whole table."""
    from tablesteps.operators.order import sort_columns

    one = df.orderBy(*sort_columns(order)).limit(1) if order else df.limit(1)
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
