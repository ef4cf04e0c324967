"""Validation queries (V2-V17) over customer with derived columns.

The derived columns give the rules something to catch: a null e-mail
for negative balances, a malformed one for one segment, a blank note
for three nations and a non-numeric age for one nation.  Every row of
customer is validated.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tablesteps.operators.validate import (
    EMAIL_PATTERN,
    Validator,
    error_counts,
    validate,
    validate_with_results,
)
from tablesteps.plans.catalogue import query, table

_V = r"""
v AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment AS segment,
        CASE WHEN c_acctbal < 0 THEN NULL
             WHEN c_mktsegment = 'MACHINERY' THEN lower(replace(c_name, '#', '_')) || '_at_example.com'
             ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com' END AS email,
        CASE WHEN c_nationkey < 3 THEN '   ' ELSE c_mktsegment END AS note,
        CASE WHEN c_nationkey = 24 THEN 'n/a' ELSE CAST(c_nationkey * 5 AS VARCHAR) END AS age
      FROM customer)
"""

_EMAIL_RE = EMAIL_PATTERN
_REQ = r"({c} IS NULL OR regexp_matches({c}, '^\s*$'))"
_BAD_EMAIL = f"(email IS NOT NULL AND NOT regexp_matches(email, '{_EMAIL_RE}'))"
_NAME_RE = r"^Customer#0000\d{4}[0-4]$"


def derived(spark, d):
    c = table(spark, d, "customer")
    email = (
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
        .when(
            F.col("c_mktsegment") == "MACHINERY",
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("_at_example.com")),
        )
        .otherwise(
            F.concat(
                F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                F.lit("@"),
                F.lower("c_mktsegment"),
                F.lit(".com"),
            )
        )
    )
    note = F.when(F.col("c_nationkey") < 3, F.lit("   ")).otherwise(F.col("c_mktsegment"))
    age = F.when(F.col("c_nationkey") == 24, F.lit("n/a")).otherwise((F.col("c_nationkey") * 5).cast("string"))
    return c.select(
        "c_custkey",
        "c_name",
        "c_acctbal",
        "c_nationkey",
        F.col("c_mktsegment").alias("segment"),
        email.alias("email"),
        note.alias("note"),
        age.alias("age"),
    )


def _counts_sql(parts: list[tuple[str, str, str]]) -> str:
    """parts: (column, message SQL expression, bad condition)."""
    selects = [
        f"SELECT '{col}' AS err_column, {msg} AS err_message, count(*) AS n_errors FROM v WHERE {bad} GROUP BY 2"
        for col, msg, bad in parts
    ]
    return f"WITH {_V} SELECT err_column, err_message, CAST(sum(n_errors) AS BIGINT) AS n_errors FROM (" + " UNION ALL ".join(
        selects
    ) + ") GROUP BY err_column, err_message"


def _counts(spark, d, rules: Validator):
    out = error_counts(derived(spark, d), rules)
    return out.select("err_column", "err_message", "n_errors")


@query(
    "validate_required",
    _counts_sql(
        [
            ("email", "'Field is required'", _REQ.format(c="email")),
            ("note", "'Field is required'", _REQ.format(c="note")),
        ]
    ),
)
def validate_required(spark, d):
    return _counts(spark, d, Validator().column("email").required().column("note").required().validator)


@query("validate_email", _counts_sql([("email", "'Invalid email format'", _BAD_EMAIL)]))
def validate_email(spark, d):
    return _counts(spark, d, Validator().column("email").email().validator)


@query(
    "validate_regex",
    _counts_sql(
        [("c_name", f"'Value must match pattern: {_NAME_RE}'", f"NOT regexp_matches(c_name, '{_NAME_RE}')")]
    ),
)
def validate_regex(spark, d):
    return _counts(spark, d, Validator().column("c_name").regex(_NAME_RE).validator)


_RANGE_BAD = "(age IS NOT NULL AND (TRY_CAST(age AS DOUBLE) IS NULL OR TRY_CAST(age AS DOUBLE) < 0 OR TRY_CAST(age AS DOUBLE) > 100))"
_RANGE_MSG = "CASE WHEN TRY_CAST(age AS DOUBLE) IS NULL THEN 'Value must be numeric' ELSE 'Value must be between 0 and 100' END"


@query("validate_range", _counts_sql([("age", _RANGE_MSG, _RANGE_BAD)]))
def validate_range(spark, d):
    return _counts(spark, d, Validator().column("age").range(0, 100).validator)


@query(
    "validate_length",
    _counts_sql(
        [
            ("segment", "'Minimum length is 9 characters'", "length(segment) < 9"),
            ("segment", "'Maximum length is 9 characters'", "length(segment) > 9"),
        ]
    ),
)
def validate_length(spark, d):
    return _counts(spark, d, Validator().column("segment").min_length(9).max_length(9).validator)


@query("validate_custom", _counts_sql([("c_acctbal", "'Balance must not be negative'", "NOT coalesce(c_acctbal >= 0, false)")]))
def validate_custom(spark, d):
    rules = Validator().column("c_acctbal").custom(lambda c: c >= 0, "Balance must not be negative").validator
    return _counts(spark, d, rules)


@query(
    "validate_in",
    _counts_sql(
        [
            (
                "segment",
                "'Value must be one of: BUILDING, MACHINERY, FURNITURE'",
                "segment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
            )
        ]
    ),
)
def validate_in(spark, d):
    return _counts(spark, d, Validator().column("segment").is_in(["BUILDING", "MACHINERY", "FURNITURE"]).validator)


@query(
    "validate_not_in",
    _counts_sql([("c_nationkey", "'Value must not be one of: 0, 1, 2'", "c_nationkey IN (0, 1, 2)")]),
)
def validate_not_in(spark, d):
    return _counts(spark, d, Validator().column("c_nationkey").not_in([0, 1, 2]).validator)


@query(
    "validate_type",
    _counts_sql([("age", "'Value must be of type Int32'", "age IS NOT NULL AND TRY_CAST(age AS INTEGER) IS NULL")]),
)
def validate_type(spark, d):
    return _counts(spark, d, Validator().column("age").of_type("int").validator)


# ---------------------------------------------------------------- modes
def _full_rules() -> Validator:
    return (
        Validator()
        .column("email").required().email()
        .column("age").range(0, 100)
        .column("segment").is_in(["BUILDING", "MACHINERY", "FURNITURE"]).max_length(9)
        .validator
    )


_SEG_IN = "segment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"
_SUMMARY = f"""concat_ws('; ',
    CASE WHEN {_REQ.format(c='email')} THEN 'email: Field is required' END,
    CASE WHEN {_BAD_EMAIL} THEN 'email: Invalid email format' END,
    CASE WHEN {_RANGE_BAD} THEN 'age: ' || {_RANGE_MSG} END,
    CASE WHEN {_SEG_IN} THEN 'segment: Value must be one of: BUILDING, MACHINERY, FURNITURE' END,
    CASE WHEN length(segment) > 9 THEN 'segment: Maximum length is 9 characters' END)"""


@query(
    "validate_skip",
    f"""WITH {_V}, r AS (SELECT *, {_SUMMARY} AS s FROM v)
        SELECT c_custkey, c_name, c_acctbal, c_nationkey, segment, email, note, age FROM r WHERE s = ''""",
)
def validate_skip(spark, d):
    return validate(derived(spark, d), _full_rules(), "skip")


@query(
    "validate_results",
    f"""WITH {_V}, r AS (SELECT c_custkey, {_SUMMARY} AS s FROM v)
        SELECT c_custkey, s = '' AS is_valid, CASE WHEN s = '' THEN 'Valid' ELSE s END AS summary FROM r""",
)
def validate_results(spark, d):
    return validate_with_results(derived(spark, d), _full_rules()).select("c_custkey", "is_valid", "summary")


@query(
    "validate_summary",
    f"""WITH {_V}, r AS (SELECT {_SUMMARY} AS s FROM v)
        SELECT CASE WHEN s = '' THEN 'Valid' ELSE s END AS summary, count(*) AS n_rows FROM r GROUP BY 1""",
)
def validate_summary(spark, d):
    res = validate_with_results(derived(spark, d), _full_rules())
    return res.groupBy("summary").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "validate_log_counts",
    f"""WITH {_V}, r AS (SELECT {_SUMMARY} AS s FROM v)
        SELECT count(*) AS n_rows, count(*) FILTER (s <> '') AS invalid_rows,
               CAST(sum(CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '; ')) END) AS BIGINT) AS errors FROM r""",
)
def validate_log_counts(spark, d):
    """The rows pass unchanged into a sink; the counts observed on the way are the result."""
    seen = Observation("validation")
    validate(derived(spark, d), _full_rules(), "log", seen).write.format("noop").mode("overwrite").save()
    counts = seen.get
    row = tuple(int(counts[k]) for k in ("rows", "invalid_rows", "errors"))
    return spark.createDataFrame([row], "n_rows long, invalid_rows long, errors long")


@query(
    "validate_fix",
    f"""WITH {_V}
        SELECT c_custkey,
               CASE WHEN {_BAD_EMAIL} THEN 'unknown@example.com' ELSE email END AS email,
               CASE WHEN {_RANGE_BAD} THEN '0' ELSE age END AS age,
               segment
        FROM v""",
)
def validate_fix(spark, d):
    rules = (
        Validator()
        .column("email").required().email(fix=F.lit("unknown@example.com"))
        .column("age").range(0, 100, fix=F.lit("0"))
        .column("segment").is_in(["BUILDING"])
        .validator
    )
    return validate(derived(spark, d), rules, "fix").select("c_custkey", "email", "age", "segment")


def _err_rows(col: str, msg_sql: str, bad: str, value_sql: str) -> str:
    return f"SELECT c_custkey, '{col}' AS column, {msg_sql} AS message, {value_sql} AS value FROM v WHERE {bad}"


@query(
    "validate_error_table",
    f"""WITH {_V} """
    + " UNION ALL ".join(
        [
            _err_rows("email", "'Field is required'", _REQ.format(c="email"), "CAST(NULL AS VARCHAR)"),
            _err_rows("email", "'Invalid email format'", _BAD_EMAIL, "email"),
            _err_rows("age", _RANGE_MSG, _RANGE_BAD, "age"),
            _err_rows("segment", "'Value must be one of: BUILDING, MACHINERY, FURNITURE'", _SEG_IN, "segment"),
            _err_rows("segment", "'Maximum length is 9 characters'", "length(segment) > 9", "segment"),
        ]
    ),
)
def validate_error_table(spark, d):
    from tablesteps.operators.validate import error_table

    return error_table(derived(spark, d), _full_rules(), ["c_custkey"])
