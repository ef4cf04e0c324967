"""First rows that compare as wanted, against brute force."""

import operator
import random

import pytest

from tablesteps.operators import upsert as U
from tablesteps.operators.order import asc

SIGNS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def compares(a, sign, b):
    """As Spark compares numbers: NaN equals itself and is above all."""
    if a is None or b is None:
        return False
    return SIGNS[sign]((a != a, 0.0 if a != a else a), (b != b, 0.0 if b != b else b))


def upserted(target, source, compared):
    rows, hits, inserted = {o: (k, x, y, o) for k, x, y, o in target}, {}, []
    for k, x, y, q in sorted(source, key=lambda r: r[3]):
        held = [t[3] for t in target if k is not None and t[0] == k and all(compares(t[i], sign, (None, x, y)[i]) for i, sign in compared)]
        if held:
            hits[min(held)] = (k, x, y)
        else:
            inserted.append((k, x, y, None))
    return sorted([*((*hits[o], o) if o in hits else r for o, r in rows.items()), *inserted], key=repr)


@pytest.mark.parametrize("signs", [(">", ">="), ("<=", "<"), (">=", "<="), ("<", ">"), (">",), ("<=",)])
def test_upsert_by_comparisons_over_many_partitions(spark, signs):
    rng = random.Random(repr(signs))
    key = lambda: rng.choice([0, 0, 0, 0, 0, 1, 2, None])
    x = lambda: rng.choice([None, *range(12)])
    y = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, -2.5, rng.gauss(0, 9), rng.gauss(0, 9), rng.gauss(0, 9)])
    places = rng.sample(range(1000), 150)
    target = [(key(), x(), y(), o) for o in places]
    source = [(key(), x(), y(), q) for q in range(120)]
    compared = list(zip((1, 2), signs))
    t = spark.createDataFrame(target, "k int, `x.1` int, y double, o int")
    s = spark.createDataFrame(source, "k int, `x.1` int, y double, q int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # the hot key fills many of them
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        names = [("x.1", signs[0], "x.1"), *[("y", sign, "y") for sign in signs[1:]]]
        out = U.upsert_predicate(t, s, [("k", "k")], [asc("o")], [asc("q")], names)
        got = [tuple(r) for r in out.select("k", "`x.1`", "y", "o").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    same = lambda rows: sorted((repr((k, a, b + 0.0 if b is not None else b, o)) for k, a, b, o in rows))
    assert same(got) == same(upserted(target, source, compared))


def test_rows_that_find_nothing_cost_no_pairs(spark):
    """Every source row is above every target but one; a pair of each would be 400 million comparisons."""
    n = 20_000
    t = spark.range(n).selectExpr("0 AS k", "id AS o", "date_add(date'2000-01-01', cast(id % 100 AS int)) AS d", "cast(id AS decimal(12,2)) AS p")
    s = spark.range(n).selectExpr("0 AS k", "id AS q", "date'1999-01-01' AS d", f"cast(id + {n - 1} AS decimal(12,2)) AS p")
    out = U.upsert_predicate(t, s, [("k", "k")], [asc("o")], [asc("q")], [("d", ">", "d"), ("p", ">=", "p")])
    assert out.count() == 2 * n - 1 and out.filter(f"o = {n - 1} AND p = {n - 1} AND d = '1999-01-01'").count() == 1


def test_comparisons_are_checked(spark):
    t, s = spark.sql("SELECT 1 AS k, 1 AS o, 'a' AS v, 'b' AS w"), spark.sql("SELECT 1 AS k, 1 AS q, 'a' AS v, 'b' AS w")
    for wrong in ([], [("o", "=", "q")], [("o", ">", "q")] * 3, [("v", ">", "v"), ("w", ">", "w")]):
        with pytest.raises(ValueError):
            U.upsert_predicate(t, s, [("k", "k")], [asc("o")], [asc("q")], wrong)
    # Texts may be one of two comparisons.
    out = U.upsert_predicate(t, s, [("k", "k")], [asc("o")], [asc("q")], [("o", ">=", "q"), ("v", "<=", "v")])
    assert out.count() == 1
    assert U.upsert_predicate(t.limit(0), s, [("k", "k")], [asc("o")], [asc("q")], [("v", "<", "v")]).count() == 1
