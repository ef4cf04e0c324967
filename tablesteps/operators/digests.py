"""The rows in which two large tables differ (T17), found by a tree of digests.

Both tables are dealt into leaves by a hash of their keys.  A leaf's digest
is its row count and sums over two 64-bit hashes of its rows: sums commute, so
each task adds up its own rows and only one small row per leaf and task moves,
whatever the order or skew of the rows.  Leaves with equal digests hold the
same rows; the others are split into finer leaves by one more scan each time,
until what they hold is small or the tree ends.  Only rows of leaves that
differ are compared whole.  Equal tables thus cost two scans and no shuffle
of rows, and a few changed rows a few scans more; tables that differ
everywhere cost what ``difference_counts`` costs, after one level of digests.

Rows that differ lie in leaves of equal digests only if two 128-bit hash sums
agree by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tablesteps.functions.names import named
from tablesteps.operators.compare import _same_shape

#: Bits by which one level of the tree splits: 2^LEVEL_BITS leaves at most are broadcast.
LEVEL_BITS = 12
#: The deepest level.
MAX_BITS = 48
#: Leaves that differ are compared whole once they hold this many rows together, or fewer.
COMPARE_ROWS = 1 << 20


def _hashed(name: str, kind: DataType) -> list[Column]:
    """A column for ``xxhash64``, which skips nulls: the flag tells (null, x) from (x, null)."""
    value = named(name)
    if isinstance(kind, (ArrayType, StructType)):
        value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
    return [value, named(name).isNull()]


def _leaf(df: DataFrame, keys: Sequence[str], bits: int) -> Column:
    """The leaf of a row: the first ``bits`` bits of the hash of its keys."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [c for k in keys for c in _hashed(k, kinds[k])]
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - bits)


def leaf_digests(df: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``leaf``, ``n`` and four sums, one row for each leaf that holds rows."""
    parts = [c for f in df.schema.fields for c in _hashed(f.name, f.dataType)]
    first, second = F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
    low = F.lit(0xFFFFFFFF)
    # Halves of 32 bits: a leaf may hold 2^31 rows before a sum leaves its 64 bits.
    halves = [h for x in (first, second) for h in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32))]
    hashed = df.select(_leaf(df, keys, bits).alias("leaf"), *[h.alias(f"h{i}") for i, h in enumerate(halves)])
    return hashed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])


def _differing(a: DataFrame, b: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Leaves whose digests differ, with the rows they hold in both tables."""
    parts = ["n", "h0", "h1", "h2", "h3"]
    left = leaf_digests(a, keys, bits).select("leaf", F.struct(*parts).alias("x"))
    right = leaf_digests(b, keys, bits).select("leaf", F.struct(*parts).alias("y"))
    both = left.join(right, "leaf", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    held = F.coalesce(F.col("x.n"), F.lit(0)) + F.coalesce(F.col("y.n"), F.lit(0))
    return both.select("leaf", held.alias("rows"))


def _within(df: DataFrame, keys: Sequence[str], bits: int, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves (their number is bounded, see ``changed_leaves``)."""
    inner = df.withColumn("_leaf", _leaf(df, keys, bits))
    return inner.join(F.broadcast(leaves), inner["_leaf"] == leaves["leaf"], "left_semi").drop("_leaf")


def changed_leaves(
    a: DataFrame, b: DataFrame, keys: Sequence[str], level_bits: int = LEVEL_BITS, compare_rows: int = COMPARE_ROWS
) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """Both tables cut to the leaves that differ, and for each level its bits, leaves and rows left.

    A level asks for at most ``2^level_bits`` leaves.  The tree goes on while
    the leaves that differ hold more than ``compare_rows`` rows and their
    children are no more than that bound, so a difference that is spread over the
    whole table stops after one level.
    """
    spark, bound, bits, log = a.sparkSession, 1 << level_bits, level_bits, []
    while True:
        found = _differing(a, b, keys, bits).collect()  # at most 2^level_bits rows of two numbers
        rows = sum(r["rows"] for r in found)
        log.append((bits, len(found), rows))
        leaves = spark.createDataFrame([(r["leaf"],) for r in found], "leaf long")
        a, b = _within(a, keys, bits, leaves), _within(b, keys, bits, leaves)
        more = (bound // max(len(found), 1)).bit_length() - 1  # bits that the next level can add
        if rows <= compare_rows or more < 1 or bits + more > MAX_BITS:
            return a, b, log
        bits += more


def differing_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    level_bits: int = LEVEL_BITS,
    compare_rows: int = COMPARE_ROWS,
    side: str = "side",
    surplus: str = "surplus",
) -> DataFrame:
    """Every distinct row that one table holds more often than the other: ``side`` (``left`` or ``right``),
    ``surplus`` (how many more), and the row's columns under the names of ``a``.

    ``keys`` deal the rows into leaves; they need not be unique, and a hot key
    only makes its leaf large.  Nulls compare equal.  Maps cannot be compared.
    """
    if not _same_shape(a, b):
        raise ValueError("tables differ in width or column names")
    cols = a.columns
    if {side.lower(), surplus.lower()} & {c.lower() for c in cols}:
        raise ValueError("side and surplus must not be columns of the tables")
    for f, g in zip(a.schema.fields, b.schema.fields):
        if f.dataType.simpleString() != g.dataType.simpleString():
            raise ValueError(f"{f.name} is {f.dataType.simpleString()} and {g.dataType.simpleString()}: hashes would differ")
    own = [next(c for c in cols if c.lower() == k.lower()) for k in keys]
    left, right, _ = changed_leaves(a, b.toDF(*cols), own, level_bits, compare_rows)
    picked = [named(c) for c in cols]
    tagged = left.select(*picked, F.lit(1).alias(surplus)).unionAll(right.select(*picked, F.lit(-1).alias(surplus)))
    per_row = tagged.groupBy(*picked).agg(F.sum(named(surplus)).alias(surplus)).filter(named(surplus) != 0)
    return per_row.select(
        F.when(named(surplus) > 0, F.lit("left")).otherwise(F.lit("right")).alias(side), F.abs(named(surplus)).alias(surplus), *picked
    )
