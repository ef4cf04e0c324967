"""Typed cell access, conversion and schema inference (T15, T16, §1.3).

* ``get_value``      GetValue<T>: cast that fails on a bad value, null -> the type's default
* ``try_get_value``  TryGetValue<T>: null on a bad value
* ``infer_types``    one aggregate pass over text columns -> narrowest type per column
* ``conform``        type-directed conversion of a whole table plus a failed-cell report
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inference rules of the reference's CSV reader.
INT_MAX_CHARS = 10
BOOL_TEXTS = ("true", "True", "TRUE", "false", "False", "FALSE")
# default(T) of .NET value types, by Spark type name.
TYPE_DEFAULTS = {
    "int": 0,
    "bigint": 0,
    "smallint": 0,
    "double": 0.0,
    "float": 0.0,
    "boolean": False,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def get_value(c: str | Column, to_type: str) -> Column:
    """T15 GetValue<T>: strict cast (ANSI: a bad value fails the job);
    null gives the type's default (0, false) or null for reference types."""
    v = _col(c).cast(to_type)
    d = TYPE_DEFAULTS.get(to_type)
    return v if d is None else F.coalesce(v, F.lit(d).cast(to_type))


def try_get_value(c: str | Column, to_type: str) -> Column:
    """T15 TryGetValue<T>: null when the value does not convert."""
    return _col(c).try_cast(to_type)


def _only(v: Column, chars: str) -> Column:
    """True when ``v`` holds nothing but ``chars`` (a char loop, no regex)."""
    return F.length(F.translate(v, chars, "")) == 0


def text_int(c: str | Column, to_type: str = "int") -> Column:
    v = _col(c)
    return F.when(_only(F.trim(v), "0123456789+-"), v.try_cast(to_type))


def text_double(c: str | Column) -> Column:
    v = _col(c)
    return F.when(_only(F.trim(v), "0123456789+-.eE"), v.try_cast("double"))


def text_timestamp(c: str | Column) -> Column:
    """Zone-less timestamp from text, else null.

    Only digits and ``-/:. T`` are allowed, with a ``-`` or ``/``; slash
    dates (``yyyy/MM/dd``, ``MM/dd/yyyy``) are rewritten to ISO order and
    the text is cast.  The cast parses without throwing, so a failed cell
    costs no exception.
    """
    t = F.trim(_col(c).cast("string"))
    maybe = _only(t, "0123456789-/:. T") & (t.contains("-") | t.contains("/"))
    us = F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    iso = F.regexp_replace(us, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    text = F.when(t.contains("/"), iso).otherwise(t)
    return F.when(maybe & ~t.contains(".."), text.try_cast("timestamp_ntz"))


def text_boolean(c: str | Column) -> Column:
    """Boolean from text; ``0``/``1`` accepted as in the table conversion."""
    t = F.trim(_col(c).cast("string"))
    low = F.lower(t)
    return (
        F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False)).otherwise(F.lit(None))
    )


def convert(c: str | Column, to_type: str, from_type: T.DataType | None = None) -> Column:
    """Type-directed conversion of one cell; null when it does not convert.

    Text goes through the text rules; typed values are cast directly.
    """
    t = to_type.lower()
    col = _col(c)
    if from_type is not None and not isinstance(from_type, T.StringType):
        return col.try_cast(t)
    if t == "boolean":
        return text_boolean(col)
    if t in ("int", "bigint", "smallint", "tinyint"):
        return text_int(col, t)
    if t in ("double", "float"):
        return text_double(col).cast(t)
    if t in ("timestamp", "timestamp_ntz"):
        return text_timestamp(col.cast("string"))
    if t == "date":
        return text_timestamp(col.cast("string")).cast("date")
    return col.try_cast(t)


DIGITS = "0123456789"


def cell_kind(v: Column, rest: Column | None = None) -> Column:
    """Kind code of one trimmed text cell: 1 int, 2 double, 3 boolean,
    4 timestamp, 0 other, null for null.

    ``rest`` is the cell with its digits removed (computed once per cell);
    every check reads that short residue first, so a cast only runs on
    cells that already have the right shape and never throws.
    """
    r = F.translate(v, DIGITS, "") if rest is None else rest
    has_digit = F.length(v) > F.length(r)
    signed = F.substring(v, 1, 1).isin("-", "+")
    int_shape = has_digit & (F.length(v) <= INT_MAX_CHARS) & ((r == "") | (r.isin("-", "+") & signed))
    dbl_shape = has_digit & r.contains(".") & (F.length(F.translate(r, ".+-eE", "")) == 0)
    ts_shape = has_digit & (r.contains("-") | r.contains("/")) & (F.length(F.translate(r, "-/: .T", "")) == 0)
    # ``r`` sits in the first (always evaluated) condition, so codegen
    # computes it once per cell and shares it with the later branches
    return (
        F.when(r.isNull(), F.lit(None).cast("int"))
        .when(int_shape & v.try_cast("int").isNotNull(), F.lit(1))
        .when(dbl_shape & v.try_cast("double").isNotNull(), F.lit(2))
        .when(v.isin(*BOOL_TEXTS), F.lit(3))
        .when(ts_shape & _timestamp_of_shaped(v).isNotNull(), F.lit(4))
        .otherwise(F.lit(0))
    )


def _timestamp_of_shaped(t: Column) -> Column:
    """Cast a date-shaped cell; slash dates are rewritten to ISO order first."""
    us = F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    iso = F.regexp_replace(us, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.when(t.contains("/"), iso).otherwise(t).try_cast("timestamp_ntz")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """§1.3 over all rows, in one pass: each cell is classified once, then
    a few counts per column are aggregated (partial aggregation per task).

    int    : every non-null cell has at most 10 chars and parses as int
    double : every cell is int-like or contains '.' and parses as double
    boolean: every cell is one of the exact boolean casings
    timestamp: every cell contains '-' or '/' and parses as a date/time
    else string (also for all-null columns).
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return {}
    # One row per cell, so that the checks are compiled once, however wide the table is.
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in cols])).alias("i", "v")).filter("v is not null")
    trimmed = cells.select("i", F.trim("v").alias("v"))
    # residues in their own projection: computed once, read by every check
    shaped = trimmed.select("i", "v", F.translate("v", DIGITS, "").alias("r"))
    kinds = shaped.select("i", cell_kind(F.col("v"), F.col("r")).alias("k"))
    # one bit per kind seen in the column; nulls add nothing
    masks = kinds.groupBy("i").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("m"))
    row = dict(masks.collect())  # one number per column
    out = {}
    for i, c in enumerate(cols):
        out[c] = _type_of_mask(row.get(i))
    return out


def _type_of_mask(mask: int | None) -> str:
    """Kinds seen (bit k set for kind k) -> narrowest column type."""
    if not mask:
        return "string"
    if mask == 1 << 1:
        return "int"
    if mask & ~((1 << 1) | (1 << 2)) == 0:
        return "double"
    if mask == 1 << 3:
        return "boolean"
    if mask == 1 << 4:
        return "timestamp_ntz"
    return "string"


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Convert text columns to the inferred types (all cells are known to fit)."""
    out = []
    for c in df.columns:
        t = types.get(c)
        if t is None or t == "string":
            out.append(F.col(f"`{c}`"))
        elif t == "boolean":
            out.append(F.lower(F.col(f"`{c}`")).try_cast("boolean").alias(c))
        elif t == "timestamp_ntz":
            out.append(text_timestamp(F.col(f"`{c}`")).alias(c))
        else:  # every cell is known to convert: a plain cast
            out.append(F.col(f"`{c}`").try_cast(t).alias(c))
    return df.select(*out)


def unique_names(names: list[str]) -> list[str]:
    """T16 unique column names: later duplicates (case-insensitive) get ``_1``, ``_2``..."""
    seen: set[str] = set()
    out = []
    for n in names:
        cand, k = n, 1
        while cand.lower() in seen:
            cand = f"{n}_{k}"
            k += 1
        seen.add(cand.lower())
        out.append(cand)
    return out


def conform(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """T16 conform a table to target types; unlisted columns are kept.

    Cells that do not convert become null (the column keeps its target
    type instead of silently turning into text, defects D10/D11).
    """
    names = unique_names(df.columns)
    types = [f.dataType for f in df.schema.fields]
    out = []
    by_place = df.toDF(*[f"c{i}" for i in range(len(names))])  # duplicate names cannot be told apart by name
    for i, (src, name, dt) in enumerate(zip(df.columns, names, types)):
        t = schema.get(name) or schema.get(src)
        c = F.col(f"c{i}")
        out.append((convert(c, t, dt) if t else c).alias(name))
    return by_place.select(*out)


def failed_cells(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Per target column, how many non-null cells fail to convert (one row)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [
        F.count_if(F.col(f"`{c}`").isNotNull() & convert(F.col(f"`{c}`"), t, types.get(c)).isNull()).alias(c)
        for c, t in schema.items()
    ]
    return df.agg(*aggs)
