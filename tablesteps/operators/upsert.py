"""Upserts as joins.

A load into a keyed table is expressed as the table it produces:

* ``upsert_do_nothing``  target + (first source row per key, keys not in target)
* ``upsert_update``      target with source's non-key columns overwritten
                          where the key matches (last source row per key
                          wins); target-only columns stay; new keys insert
* ``upsert_replace``     whole-document replace: (target without the
                          source's keys) + last source row per key
* ``upsert_predicate``   insert-or-update by a match condition

Each is one join of the target with the source reduced per key
(``first_per_key`` cuts a hot key down in every map task).  Null keys never
match (SQL unique semantics): such source rows always insert.  They travel
through the same join, spread by a hash of the row, so that many null keys
do not meet in one task.  Catalyst and AQE choose the join by measured
sizes; building a plan runs no job (but with a residual condition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.names import named
from tablesteps.operators.compared import COMPARISONS, first_compared
from tablesteps.operators.order import Key, OrderSpec, first_per_key, require_order, with_row_index
from tablesteps.session import written_copy

#: Rows of a key in one block where a residual condition has to be tried: a cell compares the square of this at most.
BLOCK = 4096


def _spelled(df: DataFrame, name: str) -> str:
    """The column's own spelling of a name."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def _null_in(keys: Sequence[str]) -> Column:
    null = F.lit(False)
    for k in keys:
        null = null | named(k).isNull()
    return null


def _spread(df: DataFrame, keys: Sequence[str]) -> Column:
    """0 for a row with a key, a hash of the row for one with a null in it: never compared (null matches
    nothing), it only keeps such rows from meeting in one task."""
    return F.when(_null_in(keys), F.xxhash64(*[named(c) for c in df.columns])).otherwise(F.lit(0).cast("long"))


def _per_key(source: DataFrame, keys: Sequence[str], order, last: bool) -> DataFrame:
    """The first or last source row per key, and every row with a null key."""
    keyed = first_per_key(source.filter(~_null_in(keys)), keys, order, last=last)
    return keyed.unionAll(source.filter(_null_in(keys)))


def reduced_per_key(source: DataFrame, keys: Sequence[str], order: OrderSpec, last: bool) -> DataFrame:
    """The first or last source row per key, and every row with a null key."""
    return _per_key(source, list(keys), require_order(order, "upsert"), last)


def _sides(target: DataFrame, reduced: DataFrame, columns: Sequence[str], keys: Sequence[str], source_keys: Sequence[str]):
    """Both sides with prefixed names and a presence flag, and the match condition."""
    t = target.select(
        *[named(c).alias(f"_t_{i}") for i, c in enumerate(target.columns)],
        _spread(target, keys).alias("_t_z"),
        F.lit(True).alias("_t_hit"),
    )
    s = reduced.select(
        *[named(c).alias(f"_s_{i}") for i, c in enumerate(columns)],
        _spread(reduced, source_keys).alias("_s_z"),
        F.lit(True).alias("_s_hit"),
    )
    at_t = {c: f"_t_{i}" for i, c in enumerate(target.columns)}
    at_s = {c: f"_s_{i}" for i, c in enumerate(columns)}
    cond = F.col("_t_z") == F.col("_s_z")
    for k, sk in zip(keys, source_keys):
        cond = cond & (F.col(at_t[k]) == F.col(at_s[sk]))
    return t, s, at_t, at_s, cond


def _merged(target: DataFrame, source: DataFrame, keys: Sequence[str], order, last: bool, overwrite: bool) -> DataFrame:
    t_keys = [_spelled(target, k) for k in keys]
    s_keys = [_spelled(source, k) for k in keys]
    reduced = _per_key(source, s_keys, order, last)
    t, s, at_t, at_s, cond = _sides(target, reduced, source.columns, t_keys, s_keys)
    own = {c.lower(): at_s[c] for c in source.columns}
    key_low = {k.lower() for k in keys}
    out = []
    for c in target.columns:
        old, new = F.col(at_t[c]), own.get(c.lower())
        if new is None:
            out.append(old.alias(c))
        elif c.lower() in key_low or not overwrite:
            out.append(F.when(F.col("_t_hit"), old).otherwise(F.col(new)).alias(c))
        else:
            out.append(F.when(F.col("_s_hit"), F.col(new)).otherwise(old).alias(c))
    return t.join(s, cond, "full_outer").select(*out)


def upsert_do_nothing(target: DataFrame, source: DataFrame, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """W11 ON CONFLICT DO NOTHING: first row per key wins, existing keys ignored."""
    return _merged(target, source, keys, require_order(order, "upsert_do_nothing"), last=False, overwrite=False)


def upsert_update(target: DataFrame, source: DataFrame, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """W12 ON CONFLICT DO UPDATE: last row per key wins on the source's columns.

    With only key columns in the source this acts as do-nothing for
    existing keys (defect D17 not copied).
    """
    return _merged(target, source, keys, require_order(order, "upsert_update"), last=True, overwrite=True)


def upsert_replace(target: DataFrame, source: DataFrame, key: str | Sequence[str], order: OrderSpec) -> DataFrame:
    """W14 replace-with-upsert: the source row replaces the whole row.

    Columns are the union of both sides; a replaced row loses
    target-only values.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s_keys = [_spelled(source, k) for k in keys]
    last = _per_key(source, s_keys, require_order(order, "upsert_replace"), last=True)
    replaced = last.select(*[named(k).alias(f"_s_{i}") for i, k in enumerate(s_keys)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & (named(_spelled(target, k)) == F.col(f"_s_{i}"))
    kept = target.join(replaced, cond, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def _placed(df: DataFrame, keys: Sequence[str], order: OrderSpec, place: str) -> DataFrame:
    """Rows without a null key, with their place (from 0) among the rows of their key: by one sort by range, so a hot
    key spreads over tasks, less the place at which its key begins."""
    by_key = [Key(named(k), True) for k in keys]
    placed = with_row_index(df.filter(~_null_in(keys)), [*by_key, *order], place)
    begins = placed.groupBy(*[named(k).alias(f"_b_{i}") for i, k in enumerate(keys)]).agg(F.min(place).alias("_b_at"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (named(k) == F.col(f"_b_{i}"))
    names = [f"_b_{i}" for i in range(len(keys))]
    return placed.join(begins, same).withColumn(place, F.col(place) - F.col("_b_at")).drop("_b_at", *names)


def first_matches(
    t: DataFrame,
    s: DataFrame,
    on_t: Sequence[str],
    on_s: Sequence[str],
    t_order: OrderSpec,
    s_order: OrderSpec,
    condition: Column,
    block: int,
) -> DataFrame:
    """``s`` with ``_t_id`` of the first row of ``t`` (which holds it) of equal keys that meets ``condition``, else null.

    Both sides are cut into blocks of ``block`` rows of a key.  A round probes
    the next target blocks of each key, twice as many as the round before,
    with the source rows that have found nothing; so there are log2(blocks)
    rounds, and a row that matches early is compared with few targets.
    A cell of one source and one target block is a join key of its own: a hot
    key is spread over tasks, no cell exceeds ``block`` squared comparisons,
    and matches become one smallest place per source row before they move.
    Rows found and rows left are written tables between the rounds.
    """
    targets = written_copy(_placed(t, on_t, t_order, "_t_at"), "first-match-targets")
    last = targets.agg(F.max("_t_at")).first()[0]  # one number
    left = _placed(s, on_s, s_order, "_s_at").withColumn("_s_cell", F.floor(F.col("_s_at") / block)).drop("_s_at")
    left = written_copy(left, "first-match-left")
    ids = targets.select(*[named(k).alias(f"_i_{i}") for i, k in enumerate(on_t)], F.col("_t_at").alias("_i_at"), F.col("_t_id"))
    found: DataFrame | None = None
    first, blocks = 0, 0 if last is None else last // block + 1
    while first < blocks:
        end = 2 * first + 1  # blocks first to end - 1 in this round
        window = targets.filter((F.col("_t_at") >= first * block) & (F.col("_t_at") < end * block))
        window = window.withColumn("_t_cell", F.floor(F.col("_t_at") / block))
        keys = [f"_k_{i}" for i in range(len(on_t))]
        # How many source blocks a key has: so often its targets are sent; and how many target blocks: so often its sources.
        sent = left.groupBy(*[named(k).alias(n) for k, n in zip(on_s, keys)]).agg(F.max("_s_cell").alias("_s_most"))
        met = window.groupBy(*[named(k).alias(n) for k, n in zip(on_t, keys)]).agg(F.max("_t_cell").alias("_t_most"))
        shapes = sent.join(met, keys)
        same_t, same_s = F.lit(True), F.lit(True)
        for k_t, k_s, n in zip(on_t, on_s, keys):
            same_t, same_s = same_t & (named(k_t) == F.col(n)), same_s & (named(k_s) == F.col(n))
        right = window.join(shapes, same_t).withColumn("_t_for", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s_most"))))
        right = right.drop(*keys, "_s_most", "_t_most", "_t_id")
        probes = left.join(shapes, same_s).withColumn("_s_for", F.explode(F.sequence(F.lit(first).cast("long"), F.col("_t_most"))))
        probes = probes.drop("_s_most", "_t_most")
        cell = (F.col("_s_cell") == F.col("_t_for")) & (F.col("_s_for") == F.col("_t_cell"))
        for k_t, n in zip(on_t, keys):
            cell = cell & (named(k_t) == F.col(n))
        hits = probes.join(right, cell & condition).groupBy("_s_id", *keys).agg(F.min("_t_at").alias("_i_at"))
        named_hits = hits.withColumnRenamed("_s_id", "_h_id")
        for i, n in enumerate(keys):
            named_hits = named_hits.withColumnRenamed(n, f"_h_{i}")
        at = F.col("_h_at") == F.col("_i_at")
        for i in range(len(keys)):
            at = at & (F.col(f"_h_{i}") == F.col(f"_i_{i}"))
        matched = named_hits.withColumnRenamed("_i_at", "_h_at").join(ids, at).select("_h_id", "_t_id")
        tried = left.join(written_copy(matched, "first-match-hits"), F.col("_s_id").eqNullSafe(F.col("_h_id")), "left")
        tried = written_copy(tried, "first-match-round")
        hit = tried.filter(F.col("_h_id").isNotNull()).select("_t_id", *s.columns)
        found = hit if found is None else found.unionAll(hit)
        left = tried.filter(F.col("_h_id").isNull()).drop("_h_id", "_t_id")
        first = end
    none = F.lit(None).cast(t.schema["_t_id"].dataType).alias("_t_id")
    rest = left.select(none, *s.columns).unionAll(s.filter(_null_in(on_s)).select(none, *s.columns))
    return rest if found is None else found.unionAll(rest)


def first_compared_matches(
    t: DataFrame,
    s: DataFrame,
    on_t: Sequence[str],
    on_s: Sequence[str],
    t_order: OrderSpec,
    compared: Sequence[tuple[str, str, str]],
) -> DataFrame:
    """``first_matches`` for a condition that is one or two comparisons (target column, sign, source column): sorted
    and swept instead of probed (``operators.compared``), so rows that match late or never cost no more than others."""
    used = dict.fromkeys([*on_t, *[c for c, _, _ in compared], "_t_id"])
    targets = with_row_index(t.filter(~_null_in(on_t)).select(*[named(c) for c in used]), t_order, "_t_at")
    targets = written_copy(targets, "first-match-targets")
    rows = written_copy(s.withColumn("_s_row", F.monotonically_increasing_id()), "first-match-rows")
    at = first_compared(
        targets.select(
            *[named(k).alias(f"k{i}") for i, k in enumerate(on_t)],
            *[named(c).alias(f"v{i}") for i, (c, _, _) in enumerate(compared)],
            F.col("_t_at").alias("at"),
        ),
        rows.select(
            *[named(k).alias(f"k{i}") for i, k in enumerate(on_s)],
            *[named(c).alias(f"v{i}") for i, (_, _, c) in enumerate(compared)],
            F.col("_s_row").alias("row"),
        ),
        len(on_t),
        [sign for _, sign, _ in compared],
    )
    hits = at.join(targets.select("_t_at", "_t_id"), F.col("at") == F.col("_t_at")).select("row", "_t_id")
    return rows.join(hits, F.col("_s_row") == F.col("row"), "left").select("_t_id", *[named(c) for c in s.columns])


def _comparisons(target: DataFrame, source: DataFrame, condition) -> list[tuple[str, str, str]]:
    """Comparisons with the prefixed column names of both sides."""
    found = [(f"_t_{_spelled(target, a)}", sign, f"_s_{_spelled(source, b)}") for a, sign, b in condition]
    if not 1 <= len(found) <= 2 or not all(sign in COMPARISONS for _, sign, _ in found):
        raise ValueError(f"upsert_predicate takes one or two comparisons, each by one of {', '.join(COMPARISONS)}")
    return found


def upsert_predicate(
    target: DataFrame,
    source: DataFrame,
    on: Sequence[tuple[str, str]],
    target_order: OrderSpec,
    source_order: OrderSpec,
    condition=None,
    block: int = BLOCK,
) -> DataFrame:
    """W20 insert-or-update by a match condition.

    Each source row updates the first matching target row (all of the
    source's columns are copied); later source rows overwrite earlier
    ones; of source rows that match nothing, the last of each key is
    inserted (a later row finds the one inserted before it).  ``on`` holds
    the equality pairs (target column, source column).

    With equality only, the first target row and the last source row of each
    key are taken before the join, so a key with many rows on both sides
    costs no pairs.  ``condition`` may add a residual predicate (null counts
    as no match); rows that match nothing are then all inserted, both orders
    must be total, and building the plan runs jobs.  It is either one or two
    comparisons that must hold, ``(target column, sign, source column)`` with
    ``>``, ``>=``, ``<`` or ``<=``: they cost sorts, no pairs
    (``first_compared_matches``).  Or any deterministic ``condition(t, s)``:
    each key's targets are then probed in blocks, first ones first
    (``first_matches``), which compares a row that matches nothing with all
    targets of its key.
    """
    t_keys = require_order(target_order, "upsert_predicate")
    s_keys = require_order(source_order, "upsert_predicate")
    if not on:
        raise ValueError("upsert_predicate needs at least one equality pair")
    t = target.select(*[named(c).alias(f"_t_{c}") for c in target.columns])
    t = t.withColumn("_t_id", F.struct(*[_prefixed(k, "_t_") for k in t_keys]))
    on_t, on_s = [f"_t_{_spelled(target, a)}" for a, _ in on], [_spelled(source, b) for _, b in on]
    t_first = [Key(F.col("_t_id").getField(k.expr), k.ascending, k.collation) for k in t_keys]
    cond = F.lit(True)
    for tc, sc in zip(on_t, on_s):
        cond = cond & (named(tc) == named(f"_s_{sc}"))
    if condition is None:
        reduced = _per_key(source, on_s, s_keys, last=True)
        s = reduced.select(*[named(c).alias(f"_s_{c}") for c in source.columns])
        held = F.lit(True)
        for c in on_t:
            held = held & named(c).isNotNull()
        firsts = first_per_key(t.filter(held).select("_t_id", *[named(c) for c in on_t]), on_t, t_first)
        winners = s.join(firsts, cond, "left")
    else:
        s = source.select(*[named(c).alias(f"_s_{c}") for c in source.columns])
        s = s.withColumn("_s_id", F.struct(*[_prefixed(k, "_s_") for k in s_keys]))
        on_s = [f"_s_{c}" for c in on_s]
        s_order = [Key(F.col("_s_id").getField(k.expr), k.ascending, k.collation) for k in s_keys]
        if callable(condition):
            seen = condition(lambda c: named(f"_t_{c}"), lambda c: named(f"_s_{c}"))
            firsts = first_matches(t, s, on_t, on_s, t_first, s_order, seen, block)
        else:
            firsts = first_compared_matches(t, s, on_t, on_s, t_first, _comparisons(target, source, condition))
        # The last source row of each target row; rows that match nothing are groups of their own.
        spread = firsts.withColumn("_s_own", F.when(F.col("_t_id").isNull(), F.col("_s_id")))
        winners = first_per_key(spread, ["_t_id", "_s_own"], s_order, last=True)
    w = winners.select(
        F.col("_t_id").alias("_w_id"), *[named(f"_s_{c}") for c in source.columns], F.lit(True).alias("_w_hit")
    )
    w = w.withColumn("_w_z", _spread(w, ["_w_id"]))
    joined = t.withColumn("_t_z", F.lit(0).cast("long")).join(
        w, (F.col("_t_id") == F.col("_w_id")) & (F.col("_t_z") == F.col("_w_z")), "full_outer"
    )
    src_low = {c.lower(): c for c in source.columns}
    out = []
    for c in target.columns:
        sc = src_low.get(c.lower())
        old = named(f"_t_{c}")
        out.append(old.alias(c) if sc is None else F.when(F.col("_w_hit"), named(f"_s_{sc}")).otherwise(old).alias(c))
    return joined.select(*out)


def _prefixed(k: Key, prefix: str) -> Column:
    if not isinstance(k.expr, str):
        raise ValueError("upsert_predicate order keys must be column names")
    return named(f"{prefix}{k.expr}").alias(k.expr)
