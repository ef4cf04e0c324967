"""Grouping and aggregation.

* ``aggregate``: one row per key, named aggregates (hash aggregate with
  map-side partial aggregation, so a hot key costs one row per map task).
* ``custom_aggregate``: an opaque Python aggregator split into a partial
  step and a merge step.  Rows are reduced with pandas a batch at a time
  where they lie, and only the small partial results meet in the merge; no
  group is ever held whole by one task.
* ``group_rows``: the groupings themselves (G1) without materialising
  member lists: each row gets its group key and the group's first-seen
  position.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tablesteps.functions.names import named
from tablesteps.operators import order as _order
from tablesteps.operators.order import OrderSpec
from tablesteps.operators.rows import find_column
from tablesteps.session import ship_package

# Partial rows a task holds before it combines them.
COMBINE_ROWS = 100_000


def aggregate(df: DataFrame, key: str | list[str], **aggs: Column) -> DataFrame:
    """G2 GroupBy(key, (name, aggregator)...).

    Output: key column(s), then each aggregate in order; an aggregate
    named like a key replaces that key's value at the key's position.
    """
    keys = [key] if isinstance(key, str) else list(key)
    resolved = [find_column(df, k) or k for k in keys]
    key_low = {k.lower(): k for k in resolved}
    overriding = {n: e for n, e in aggs.items() if n.lower() in key_low}
    others = {n: e for n, e in aggs.items() if n.lower() not in key_low}
    agg_cols = [e.alias(n) for n, e in others.items()]
    agg_cols += [e.alias(f"_ovr_{n}") for n, e in overriding.items()]
    if not agg_cols:
        return df.select(*[named(k) for k in resolved]).distinct()
    grouped = df.groupBy(*[named(k) for k in resolved]).agg(*agg_cols)
    out = []
    for k in resolved:
        hit = next((n for n in overriding if n.lower() == k.lower()), None)
        out.append(named(f"_ovr_{hit}").alias(k) if hit else named(k))
    out += [named(n) for n in others]
    return grouped.select(*out)


def count_and_average(df: DataFrame, key: str, value: str, decimals: int = 2) -> DataFrame:
    """G3 template: count and banker's-rounded average per key."""
    return aggregate(
        df,
        key,
        Count=F.count(F.lit(1)),
        AvgValue=F.bround(F.avg(F.col(value)), decimals),
    )


def custom_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: StructType | str,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    vectorized: bool = False,
) -> DataFrame:
    """G2 with an opaque aggregator, in skew-safe phases.

    ``partial(pdf)`` reduces rows of one key to rows of ``partial_schema``
    (keys included); ``merge(pdf)`` turns all partial rows of one key
    into rows of ``schema``.

    With ``combine`` (partial rows of one key -> partial rows) the first
    phase is a true map-side combine: each partition is reduced per key
    inside ``mapInPandas``, again and again every ``COMBINE_ROWS`` partial
    rows, and one partial row per key and partition is shuffled.  Without
    it, one partial row per key and Arrow batch is: rows are reduced where
    they lie, a batch at a time, however many share a key.

    ``vectorized=True`` calls each function once per batch instead of
    once per group: ``partial``, ``combine`` and ``merge`` receive rows of
    many keys and group them themselves (pandas ``groupby`` with
    ``dropna=False``: null is a key).  Integer columns with nulls arrive as
    nullable integers, so large keys stay exact.
    """
    ship_package(df.sparkSession)
    if vectorized:
        if combine is None:
            raise ValueError("vectorized aggregation needs a combine function")
        return _vectorized_aggregate(df, list(keys), partial, partial_schema, combine, merge, schema)
    if combine is not None:
        key_list = list(keys)

        def reduce_by_key(fn, pdf):
            groups = [fn(g) for _, g in pdf.groupby(key_list, sort=False, dropna=False)]
            return pd.concat(groups, ignore_index=True)

        def per_partition(batches):
            yield from _combined(
                batches, lambda pdf: reduce_by_key(partial, pdf), lambda parts: reduce_by_key(combine, parts)
            )

        partials = df.mapInPandas(per_partition, partial_schema)
        return partials.groupBy(*[named(k) for k in keys]).applyInPandas(merge, schema)

    def per_batch(batches):
        for pdf in batches:
            for _, g in pdf.groupby(list(keys), sort=False, dropna=False):
                yield partial(g)

    partials = df.mapInPandas(per_batch, partial_schema)
    return partials.groupBy(*[named(k) for k in keys]).applyInPandas(merge, schema)


def _combined(batches, first: Callable, again: Callable):
    """Partial results of a partition, combined whenever ``COMBINE_ROWS`` have piled up."""
    held, rows = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(first(pdf))
        rows += len(held[-1])
        if rows >= COMBINE_ROWS:
            held = [again(pd.concat(held, ignore_index=True))]
            rows = len(held[0])
            if rows >= COMBINE_ROWS:  # so many keys: send them on
                yield held.pop()
                rows = 0
    if held:
        yield again(pd.concat(held, ignore_index=True))


def _vectorized_aggregate(df, keys, partial, partial_schema, combine, merge, schema) -> DataFrame:
    def with_integers(pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        return pdf.assign(**{n: pdf[n].astype("string").astype("Int64") for n in names if n in pdf})

    def as_text(frame: DataFrame, names: list[str]) -> DataFrame:
        # a long with nulls would reach pandas as a float and lose digits
        return frame.withColumns({n: named(n).cast("string") for n in names}) if names else frame

    key_ints = [f.name for f in df.schema.fields if f.name in keys and isinstance(f.dataType, (LongType, IntegerType))]

    def per_partition(batches):
        yield from _combined((with_integers(b, key_ints) for b in batches), partial, combine)

    def merge_partition(batches):
        yield from _merged_by_key((with_integers(pdf, key_ints) for pdf in batches), keys, combine, merge)

    partials = as_text(df, key_ints).mapInPandas(per_partition, partial_schema)
    key_columns = [named(k) for k in keys]
    dealt = partials.repartition(*key_columns).sortWithinPartitions(*key_columns)
    return as_text(dealt, key_ints).mapInPandas(merge_partition, schema)


def _merged_by_key(batches, keys: list[str], combine: Callable | None, merge: Callable):
    """Merge partial results that come sorted by key, a batch at a time.

    The last key of a batch may go on in the next one: its rows wait, all
    others are merged.  A key with very many rows is combined whenever
    ``COMBINE_ROWS`` of it have piled up, so a task holds a batch and one
    key's combined rows, never its whole partition.
    """
    held, limit = [], COMBINE_ROWS
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        is_last = pd.Series(True, index=pdf.index)
        for k in keys:
            # Null is a key like others (pandas would call it unequal to itself).
            same = pdf[k].isna() if pd.isna(last[k]) else (pdf[k] == last[k]).fillna(False)
            is_last &= same.astype(bool)
        if held and not is_last.all() or held and not _same_key(held[0], pdf, keys):
            ready = pd.concat([*held, pdf[~is_last]], ignore_index=True)
            held, limit = [], COMBINE_ROWS
            yield merge(ready)
        elif not is_last.all():
            yield merge(pdf[~is_last].reset_index(drop=True))
        held.append(pdf[is_last])
        if combine is not None and sum(map(len, held)) >= limit:
            held = [combine(pd.concat(held, ignore_index=True))]
            limit = max(COMBINE_ROWS, 2 * len(held[0]))  # a key whose rows do not shrink is not combined each time
    if held:
        yield merge(pd.concat(held, ignore_index=True))


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    """Whether the first rows of both have one key."""
    pairs = [(a[k].iloc[0], b[k].iloc[0]) for k in keys]
    return all(pd.isna(y) if pd.isna(x) else not pd.isna(y) and x == y for x, y in pairs)


def group_rows(df: DataFrame, key: str | Column, order: OrderSpec, name: str = "group_key") -> DataFrame:
    """G1 GroupBy(keySelector): every row with its group key and the
    group's first-seen index (groups come out in first-seen order).

    Only one row per group (its first order values) is indexed; the
    members stay where they are.  Null is a group of its own.
    """
    keys = _order.require_order(order, "group_rows")
    key_col = named(find_column(df, key) or key) if isinstance(key, str) else key
    tagged = df.withColumn(name, key_col)
    order_cols = [
        (F.col(k.expr) if isinstance(k.expr, str) else k.expr).alias(f"_g_o{i}") for i, k in enumerate(keys)
    ]
    local_keys = [_order.Key(f"_g_o{i}", k.ascending, k.collation) for i, k in enumerate(keys)]
    firsts = _order.first_per_key(tagged.select(name, *order_cols), [name], local_keys)
    indexed = _order.with_row_index(firsts, local_keys, "group_index").select(
        F.col(name).alias("_g_key"), "group_index"
    )
    return tagged.join(indexed, tagged[name].eqNullSafe(indexed["_g_key"]), "inner").drop("_g_key")


def group_summary(
    df: DataFrame, key: str | Column, order: OrderSpec, name: str = "group_key", **aggs: Column
) -> DataFrame:
    """G1 + G2 without touching rows twice: one row per group with its
    aggregates and its first-seen index (groups numbered in first-seen
    order).

    The first order values of each group come from the same aggregation
    (``min`` of the order struct) when every key is ascending; otherwise
    from a keep-first step.  Only the per-group table is indexed.
    """
    keys = _order.require_order(order, "group_summary")
    key_col = named(find_column(df, key) or key) if isinstance(key, str) else key
    order_cols = [
        (F.col(k.expr) if isinstance(k.expr, str) else k.expr).alias(f"_g_o{i}") for i, k in enumerate(keys)
    ]
    local_keys = [_order.Key(f"_g_o{i}", k.ascending, k.collation) for i, k in enumerate(keys)]
    tagged = df.select("*", key_col.alias(name), *order_cols)
    agg_cols = [e.alias(n) for n, e in aggs.items()]
    if all(k.ascending and not k.collation for k in keys):
        first = F.min(F.struct(*[F.col(f"_g_o{i}") for i in range(len(keys))])).alias("_g_first")
        per_group = tagged.groupBy(name).agg(*agg_cols, first).select(
            name, *aggs.keys(), *[F.col(f"_g_first._g_o{i}").alias(f"_g_o{i}") for i in range(len(keys))]
        )
    else:
        firsts = _order.first_per_key(tagged.select(name, *[f"_g_o{i}" for i in range(len(keys))]), [name], local_keys)
        sums = tagged.groupBy(name).agg(*agg_cols).withColumnRenamed(name, "_g_key")
        per_group = firsts.join(sums, firsts[name].eqNullSafe(sums["_g_key"])).drop("_g_key")
    indexed = _order.with_row_index(per_group, local_keys, "group_index")
    return indexed.select(name, "group_index", *aggs.keys())
