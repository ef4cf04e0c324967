"""JSON paths (S6): ``$.a.b[0]``, ``$.items[*]``.

Over JSON text the path goes to ``get_json_object`` (JVM-side); over a
parsed column it becomes a nested field / index expression; ``[*]``
explodes.  A missing property or index gives no value (null / no row),
it never leaves the cursor where it was (defect D18 not copied).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark's names for a property that is not there.
MISSING = {"FIELD_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"}

_TOKEN = re.compile(r"\.([^.\[\]]+)|\[(\*|\d+)\]")


def parse_path(path: str) -> list[str | int]:
    """``$.a.b[0][*]`` -> ['a', 'b', 0, '*']."""
    p = path.strip()
    if p.startswith("$"):
        p = p[1:]
    steps: list[str | int] = []
    pos = 0
    while pos < len(p):
        m = _TOKEN.match(p, pos)
        if not m:
            raise ValueError(f"bad JSON path {path!r}")
        if m.group(1) is not None:
            steps.append(m.group(1))
        else:
            steps.append("*" if m.group(2) == "*" else int(m.group(2)))
        pos = m.end()
    return steps


def path_text(json_col: str | Column, path: str) -> Column:
    """Value at ``path`` of a JSON text column, as JSON text (null if absent)."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.get_json_object(c, path)


def select_path(df: DataFrame, path: str, alias: str = "value") -> DataFrame:
    """Rows at ``path``; a missing property or index gives no rows (see ``_select_path``)."""
    from pyspark.errors import AnalysisException

    try:
        out = _select_path(df, path, alias)
        out.schema
        return out
    except AnalysisException as e:
        if e.getCondition() not in MISSING:
            raise
        return df.sparkSession.createDataFrame([], f"`{alias}` string")


def _select_path(df: DataFrame, path: str, alias: str = "value") -> DataFrame:
    """Rows at ``path`` of a parsed (struct/array) DataFrame.

    A path ending at an array of structs yields one row per element with
    the struct's fields as columns; ``[*]`` explodes in the middle too.
    """
    steps = parse_path(path)
    if not steps:
        return df
    cur: Column | None = None
    frame = df
    for i, s in enumerate(steps):
        if s == "*":
            frame = frame.select(F.explode(cur).alias("_jp"))
            cur = F.col("_jp")
            continue
        if isinstance(s, int):
            if cur is None:
                raise ValueError("a path cannot start with an index on a table")
            cur = F.get(cur, F.lit(s))
            continue
        cur = F.col(f"`{s}`") if cur is None else cur.getField(s)
    frame = frame.select(cur.alias(alias)).filter(F.col(alias).isNotNull())
    dtype = frame.schema[alias].dataType
    from pyspark.sql import types as T

    if isinstance(dtype, T.ArrayType):
        frame = frame.select(F.explode(alias).alias(alias))
        dtype = dtype.elementType
    if isinstance(dtype, T.StructType):
        return frame.select(f"{alias}.*")
    return frame
