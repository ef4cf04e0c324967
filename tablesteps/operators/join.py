"""The declared Join step (A8): equal-key joins planned by Catalyst.

Strategy is left to the optimizer and AQE: a side is broadcast only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(statistics at plan time, actual shuffle sizes at run time); otherwise a
sort-merge join, with AQE splitting skewed partitions.  ``broadcast_side``
passes the caller's hint for a side whose size the caller knows; without
it Spark's own byte limit decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteps.functions.names import quoted

JOIN_KINDS = ("inner", "left", "right", "full", "semi", "anti")
_SPARK_KIND = {"inner": "inner", "left": "left", "right": "right", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}


def join_step(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]] | Sequence[str],
    how: str = "inner",
    broadcast_side: bool = False,
) -> DataFrame:
    how = how.lower()
    if how not in JOIN_KINDS:
        raise ValueError(f"join kind must be one of {JOIN_KINDS}")
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    if not pairs:
        raise ValueError("a join step needs at least one key pair")
    if broadcast_side:
        right = F.broadcast(right)
    if all(a == b and "." not in a for a, b in pairs):
        return left.join(right, [a for a, _ in pairs], _SPARK_KIND[how])
    cond = None
    for a, b in pairs:
        e = left[quoted(a)] == right[quoted(b)]
        cond = e if cond is None else cond & e
    return left.join(right, cond, _SPARK_KIND[how])
