"""Order keys, stable sort chains and a dense row index.

The reference's operators follow arrival order and a stable sort.  Spark's
sort is not stable and a DataFrame has no arrival order, so every
order-dependent step takes an explicit list of order keys:

* ``OrderBy(k)`` then ``OrderBy(j)``: the later key dominates and the
  earlier one breaks ties -> ``chain(previous, new)``.
* ascending sorts put nulls first, descending sorts put nulls last.
* file sources can carry their arrival order (``with_arrival_order``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesteps.functions.names import named
from tablesteps.session import written_copy

# Columns added by with_arrival_order, in their sort order.
ARRIVAL_COLUMNS = ("_src_file", "_src_block", "_src_pos")


@dataclass(frozen=True)
class Key:
    """One sort key: a column name or expression, a direction and an
    optional collation for text (``"UNICODE"`` orders like a culture-aware
    comparer: ``a, b, B``; the default compares bytes)."""

    expr: str | Column
    ascending: bool = True
    collation: str | None = None

    def column(self) -> Column:
        c = F.col(self.expr) if isinstance(self.expr, str) else self.expr
        if self.collation:
            c = F.collate(c, self.collation)
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()


def asc(expr: str | Column, collation: str | None = None) -> Key:
    return Key(expr, True, collation)


def desc(expr: str | Column, collation: str | None = None) -> Key:
    return Key(expr, False, collation)


OrderSpec = Sequence["Key | str | Column"]


def keys_of(order: OrderSpec | Key | str | Column | None) -> list[Key]:
    if order is None:
        return []
    if isinstance(order, (Key, str, Column)):
        order = [order]
    out = []
    for k in order:
        out.append(k if isinstance(k, Key) else Key(k, True))
    return out


def sort_columns(order: OrderSpec | Key | str | Column | None) -> list[Column]:
    return [k.column() for k in keys_of(order)]


def chain(previous: OrderSpec | None, new: OrderSpec) -> list[Key]:
    """Stable re-sort: ``new`` dominates, ``previous`` survives as tie-break."""
    return keys_of(new) + keys_of(previous)


def require_order(order: OrderSpec | None, step: str) -> list[Key]:
    keys = keys_of(order)
    if not keys:
        raise ValueError(
            f"{step} depends on row order; pass order keys (or read the source "
            "with with_arrival_order and use ARRIVAL_COLUMNS)"
        )
    return keys


def with_arrival_order(df: DataFrame) -> DataFrame:
    """Tag rows of a file scan with (file, block start, position) columns.

    Must be applied directly on a file-based DataFrame (``_metadata`` is
    only available on scans).  Within one split ``monotonically_increasing_id``
    grows with the read position, so the three columns give file order.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(ARRIVAL_COLUMNS[0]),
        F.col("_metadata.file_block_start").alias(ARRIVAL_COLUMNS[1]),
        F.monotonically_increasing_id().alias(ARRIVAL_COLUMNS[2]),
    )


def order_by(df: DataFrame, order: OrderSpec) -> DataFrame:
    """Range-partitioned global sort."""
    return df.orderBy(*sort_columns(order))


def with_row_index(df: DataFrame, order: OrderSpec, name: str = "row_index") -> DataFrame:
    """Dense 0-based row index in ``order`` without a global window.

    The rows are sorted by range once and written to the shared folder
    with their partition and position; counts per partition (one row
    each, so their number is bounded by the partitions, not the data) give
    running offsets, which are broadcast back.  Counts and rows come
    from the same written copy, so the index does not depend on a cache, on
    sampled range bounds or on how partitions are merged later.

    ``order`` must be a total order for the index to be reproducible.
    """
    keys = require_order(order, "row index")
    part, mid, off = (f"_ri_{x}" for x in ("part", "mid", "off"))
    tagged = written_copy(
        df.orderBy(*sort_columns(keys))
        .withColumn(part, F.spark_partition_id())
        .withColumn(mid, F.monotonically_increasing_id()),
        "row-index",
    )
    counts = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("_ri_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("_ri_n").over(before), F.lit(0)).alias(off))
    # monotonically_increasing_id = (partition id << 33) + position in partition
    position = F.col(mid) - F.shiftleft(F.col(part).cast("long"), 33)
    return tagged.join(F.broadcast(offsets), part).withColumn(name, F.col(off) + position).drop(part, mid, off)


def indexed_sorted(df: DataFrame, order: OrderSpec, name: str = "row_index") -> DataFrame:
    """Row index plus the matching sort, for callers that emit ordered rows."""
    return with_row_index(df, order, name).orderBy(name)


def first_per_key(
    df: DataFrame, keys: Iterable[str | Column], order: OrderSpec, last: bool = False
) -> DataFrame:
    """Keep the first (or last) row per key in ``order``.

    ``row_number() == 1`` over a key partition is planned with a partial
    WindowGroupLimit before the shuffle, so a hot key is cut down to one
    row per map task before it moves.
    """
    ks = keys_of(order)
    if last:
        ks = [Key(k.expr, not k.ascending, k.collation) for k in ks]
    key_cols = [named(k) if isinstance(k, str) else k for k in keys]
    w = Window.partitionBy(*key_cols).orderBy(*[k.column() for k in ks])
    return df.withColumn("_fpk_rn", F.row_number().over(w)).filter("_fpk_rn = 1").drop("_fpk_rn")
