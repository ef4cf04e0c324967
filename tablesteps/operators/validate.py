"""Validation rules compiled to one expression.

A rule set becomes a single ``array<struct<column,message,value>>``
column: ``filter(array(when(bad_1, err_1), ..., when(bad_n, err_n)),
e -> e is not null)``.  That is one projection inside whole-stage
codegen; no Python runs per row.  Rules keep declaration order and all
errors of a row are collected, as in the reference.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.functions.text import net_number, net_value
from tablesteps.operators.rows import find_column

# Fixed values that must equal the reference's output.
MSG_REQUIRED = "Field is required"
MSG_EMAIL = "Invalid email format"
MSG_PATTERN = "Value must match pattern: {pattern}"
MSG_RANGE = "Value must be between {min} and {max}"
MSG_NUMERIC = "Value must be numeric"
MSG_MIN_LENGTH = "Minimum length is {n} characters"
MSG_MAX_LENGTH = "Maximum length is {n} characters"
MSG_IN = "Value must be one of: {values}"
MSG_NOT_IN = "Value must not be one of: {values}"
MSG_TYPE = "Value must be of type {name}"
SUMMARY_VALID = "Valid"
SUMMARY_SEPARATOR = "; "
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# .NET type names used in the Type<T> message, by Spark type.
NET_TYPE_NAMES = {
    "int": "Int32",
    "bigint": "Int64",
    "smallint": "Int16",
    "tinyint": "Byte",
    "double": "Double",
    "float": "Single",
    "boolean": "Boolean",
    "timestamp": "DateTime",
    "timestamp_ntz": "DateTime",
    "date": "DateTime",
    "string": "String",
}

ERROR_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("column", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


def _text(c: Column) -> Column:
    return c.cast("string")


@dataclass
class Rule:
    """One rule on one column.

    ``check(df, c)`` returns (bad, message, value); ``c`` is None when the
    column is absent from the DataFrame.
    """

    column: str
    kind: str
    params: dict = field(default_factory=dict)
    fix: Column | None = None

    def check(self, df: DataFrame, c: Column | None, dtype: T.DataType | None):
        k, p = self.kind, self.params
        if k == "required":
            if c is None:
                return F.lit(True), F.lit(MSG_REQUIRED), F.lit(None).cast("string")
            if isinstance(dtype, T.StringType):
                bad = c.isNull() | c.rlike(r"(?U)^\s*$")
            else:
                bad = c.isNull()
            return bad, F.lit(MSG_REQUIRED), F.lit(None).cast("string")
        if c is None:
            return None
        if k == "email":
            bad = c.isNotNull() & ~_text(c).rlike(EMAIL_PATTERN)
            return bad, F.lit(MSG_EMAIL), _text(c)
        if k == "regex":
            msg = p.get("message") or MSG_PATTERN.format(pattern=p["pattern"])
            bad = c.isNotNull() & ~_text(c).rlike(p["pattern"])
            return bad, F.lit(msg), _text(c)
        if k == "range":
            num = c.cast("double") if isinstance(dtype, T.NumericType) else _text(c).try_cast("double")
            out = (num < F.lit(float(p["min"]))) | (num > F.lit(float(p["max"])))
            bad = c.isNotNull() & (num.isNull() | out)
            msg = F.when(num.isNull(), F.lit(MSG_NUMERIC)).otherwise(
                F.lit(MSG_RANGE.format(min=net_number(p["min"]), max=net_number(p["max"])))
            )
            return bad, msg, _text(c)
        if k == "min_length":
            bad = c.isNotNull() & (F.length(_text(c)) < F.lit(p["n"]))
            return bad, F.lit(MSG_MIN_LENGTH.format(n=p["n"])), _text(c)
        if k == "max_length":
            bad = c.isNotNull() & (F.length(_text(c)) > F.lit(p["n"]))
            return bad, F.lit(MSG_MAX_LENGTH.format(n=p["n"])), _text(c)
        if k == "custom":
            pred = p["predicate"]
            ok = pred(c) if callable(pred) else pred
            bad = ~F.coalesce(ok, F.lit(False))
            return bad, F.lit(p["message"]), _text(c)
        if k in ("in", "not_in"):
            values = list(p["values"])
            same = [v for v in values if _same_kind(v, dtype)]
            member = c.isin(same) if same else F.lit(False)
            text = ", ".join(net_value(v) for v in values)
            if k == "in":
                return c.isNotNull() & ~member, F.lit(MSG_IN.format(values=text)), _text(c)
            return c.isNotNull() & member, F.lit(MSG_NOT_IN.format(values=text)), _text(c)
        if k == "type":
            target = p["type"]
            name = NET_TYPE_NAMES.get(target, target)
            if isinstance(dtype, T.StringType):
                conv = c.try_cast(target)
            else:
                conv = _text(c).try_cast(target)
            return c.isNotNull() & conv.isNull(), F.lit(MSG_TYPE.format(name=name)), _text(c)
        raise ValueError(f"unknown rule {k}")


def _same_kind(v, dtype) -> bool:
    """Type-strict membership: a literal only matches values of its kind."""
    if dtype is None:
        return False
    if isinstance(v, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(v, int):
        return isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    if isinstance(v, float):
        return isinstance(dtype, (T.DoubleType, T.FloatType))
    if isinstance(v, str):
        return isinstance(dtype, T.StringType)
    return True


class ColumnRules:
    """Fluent rule chain for one column; ``.column(x)`` moves to the next."""

    def __init__(self, validator: "Validator", name: str):
        self._v = validator
        self._name = name

    def _add(self, kind, fix=None, **params) -> "ColumnRules":
        self._v.rules.append(Rule(self._name, kind, params, fix))
        return self

    def required(self, fix=None):
        return self._add("required", fix)

    def email(self, fix=None):
        return self._add("email", fix)

    def regex(self, pattern: str, message: str | None = None, fix=None):
        return self._add("regex", fix, pattern=pattern, message=message)

    def range(self, min_value: float, max_value: float, fix=None):
        return self._add("range", fix, min=min_value, max=max_value)

    def min_length(self, n: int, fix=None):
        return self._add("min_length", fix, n=n)

    def max_length(self, n: int, fix=None):
        return self._add("max_length", fix, n=n)

    def custom(self, predicate: Callable[[Column], Column] | Column, message: str, fix=None):
        return self._add("custom", fix, predicate=predicate, message=message)

    def is_in(self, values: Sequence, fix=None):
        return self._add("in", fix, values=values)

    def not_in(self, values: Sequence, fix=None):
        return self._add("not_in", fix, values=values)

    def of_type(self, spark_type: str, fix=None):
        return self._add("type", fix, type=spark_type)

    def column(self, name: str) -> "ColumnRules":
        return self._v.column(name)

    and_ = column

    @property
    def validator(self) -> "Validator":
        return self._v


class Validator:
    """V1: an ordered list of rules."""

    def __init__(self):
        self.rules: list[Rule] = []

    def column(self, name: str) -> ColumnRules:
        return ColumnRules(self, name)

    # -- compilation ---------------------------------------------------
    def checks(self, df: DataFrame) -> list[tuple[Rule, Column, Column, Column]]:
        types = {f.name.lower(): f.dataType for f in df.schema.fields}
        out = []
        for r in self.rules:
            actual = find_column(df, r.column)
            c = F.col(f"`{actual}`") if actual else None
            res = r.check(df, c, types.get(r.column.lower()))
            if res is not None:
                out.append((r, *res))
        return out

    def errors(self, df: DataFrame) -> Column:
        items = []
        for r, bad, msg, value in self.checks(df):
            err = F.struct(
                F.lit(r.column).alias("column"), msg.alias("message"), value.cast("string").alias("value")
            )
            items.append(F.when(bad, err))
        if not items:
            return F.array().cast(ERROR_TYPE)
        return F.filter(F.array(*items), lambda e: e.isNotNull())

    def any_bad(self, df: DataFrame) -> Column:
        """True when some rule fails: a plain disjunction, no error array."""
        cond = F.lit(False)
        for _, bad, _, _ in self.checks(df):
            cond = cond | F.coalesce(bad, F.lit(False))
        return cond

    def bad_count(self, df: DataFrame) -> Column:
        """Number of failing rules of a row."""
        total = F.lit(0)
        for _, bad, _, _ in self.checks(df):
            total = total + F.when(bad, 1).otherwise(0)
        return total


def summary_of(errors: Column) -> Column:
    """``col: msg; col: msg`` or ``Valid``."""
    text = F.array_join(F.transform(errors, lambda e: F.concat(e["column"], F.lit(": "), e["message"])), SUMMARY_SEPARATOR)
    return F.when(F.size(errors) == 0, F.lit(SUMMARY_VALID)).otherwise(text)


def validate_with_results(df: DataFrame, validator: Validator) -> DataFrame:
    """V16 ValidateWithResults: every row plus errors, is_valid, summary."""
    errs = validator.errors(df)
    out = df.withColumn("errors", errs)
    return out.withColumn("is_valid", F.size("errors") == 0).withColumn("summary", summary_of(F.col("errors")))


def validate(df: DataFrame, validator: Validator, mode: str = "skip", observation: Observation | None = None) -> DataFrame:
    """V12-V15 Validate(cfg, mode).

    * ``skip``  drop invalid rows (default);
    * ``throw`` fail the job on the first invalid row evaluated;
    * ``log``   keep rows; counts (rows, invalid rows, errors, and one
      ``rule_<i>_<column>_<kind>`` count per rule) go to ``observation``
      in the same job (``error_table`` gives the side table);
    * ``fix``   apply each failing rule's ``fix`` expression; rules
      without one leave the value unchanged.
    """
    mode = mode.lower()
    if mode == "skip":
        return df.filter(~validator.any_bad(df))
    if mode == "throw":
        # the error text is only built for the row that fails
        msg = F.concat(F.lit("Validation failed: "), summary_of(validator.errors(df)))
        guard = F.coalesce(F.when(validator.any_bad(df), F.raise_error(msg)).cast("boolean"), F.lit(True))
        return df.filter(guard)
    if mode == "log":
        # a stream reports named metrics per micro-batch (query progress)
        obs = "validation" if df.isStreaming else (observation or Observation("validation"))
        per_rule = [
            F.sum(F.when(bad, 1).otherwise(0)).alias(f"rule_{i}_{r.column}_{r.kind}")
            for i, (r, bad, _, _) in enumerate(validator.checks(df))
        ]
        return df.observe(
            obs,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(validator.any_bad(df)).alias("invalid_rows"),
            F.sum(validator.bad_count(df)).alias("errors"),
            *per_rule,
        )
    if mode == "fix":
        out = df
        for r in validator.rules:
            if r.fix is None:
                continue
            actual = find_column(out, r.column)
            if actual is None:
                out = out.withColumn(r.column, r.fix)
                continue
            types = {f.name: f.dataType for f in out.schema.fields}
            bad, _, _ = r.check(out, F.col(f"`{actual}`"), types[actual])
            out = out.withColumn(actual, F.when(bad, r.fix).otherwise(F.col(f"`{actual}`")))
        return out
    raise ValueError(f"unknown mode {mode!r}")


def error_table(df: DataFrame, validator: Validator, id_columns: Sequence[str]) -> DataFrame:
    """One row per error: id columns, column, message, value."""
    errs = validator.errors(df)
    return df.select(*id_columns, F.explode(errs).alias("e")).select(
        *id_columns, F.col("e.column").alias("column"), F.col("e.message").alias("message"), F.col("e.value").alias("value")
    )


def error_counts(df: DataFrame, validator: Validator) -> DataFrame:
    """Errors per (column, message): the compact report of a validation run."""
    errs = validator.errors(df)
    return (
        df.select(F.explode(errs).alias("e"))
        .groupBy(F.col("e.column").alias("err_column"), F.col("e.message").alias("err_message"))
        .agg(F.count(F.lit(1)).alias("n_errors"))
    )
