"""Differences of two tables through digests, against a multiset difference."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesteps.operators.digests import changed_leaves, differing_rows

SCHEMA = "k long, v string, `x.y` double"


def brute(a, b):
    x, y = Counter(a), Counter(b)
    return sorted([("left", n) + r for r, n in (x - y).items()] + [("right", n) + r for r, n in (y - x).items()], key=repr)


def run(spark, a, b, **options):
    out = differing_rows(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["K"], **options)
    assert out.columns == ["side", "surplus", "k", "v", "x.y"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_against_multiset_difference(spark, seed):
    rng = random.Random(seed)
    pick = lambda: (rng.choice([None, 1, 2, 3, 500]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.5, 1.5]))
    a = [pick() for _ in range(300)]
    b = a[:280] + [pick() for _ in range(25)]
    rng.shuffle(b)
    expected = brute(a, b)
    assert run(spark, a, b) == expected
    assert run(spark, a, b, level_bits=3, compare_rows=5) == expected


def test_equal_tables_and_empty_ones(spark):
    rows = [(i % 7, str(i), None) for i in range(100)]
    assert run(spark, rows, rows[::-1]) == [] and run(spark, [], []) == []
    assert run(spark, rows[:1], []) == [("left", 1, 0, "0", None)]


def test_even_numbers_of_copies_and_moved_nulls_count(spark):
    assert run(spark, [(1, "a", None)] * 2, [(1, "b", None)] * 2) == [("left", 2, 1, "a", None), ("right", 2, 1, "b", None)]
    a = spark.createDataFrame([(1, "x", None)], "k long, p string, q string")
    b = spark.createDataFrame([(1, None, "x")], "k long, p string, q string")
    assert differing_rows(a, b, ["k"]).count() == 2


def test_nested_columns(spark):
    a = spark.range(20).select("id", F.array("id", F.lit(None)).alias("l"), F.struct(F.lit(None).cast("int").alias("u"), "id").alias("s"))
    b = a.withColumn("l", F.when(F.col("id") == 3, F.array(F.lit(None), "id")).otherwise(F.col("l")))
    assert sorted((r.side, r.id) for r in differing_rows(a, b, ["id"]).collect()) == [("left", 3), ("right", 3)]


def test_one_changed_row_is_named_from_few_rows(spark):
    a = spark.range(50000).select("id", (F.col("id") * 3).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 777, F.lit(0)).otherwise(F.col("v")))
    left, right, log = changed_leaves(a, b, ["id"], level_bits=6, compare_rows=10)
    assert [n for _, n, _ in log] == [1] * len(log) and 2 <= len(log) <= 4
    assert log[0][2] > 1000 and log[-1][2] <= 10 and left.count() <= 5 and right.filter("id = 777").count() == 1
    out = differing_rows(a, b, ["id"])
    assert sorted(tuple(r) for r in out.collect()) == [("left", 1, 777, 2331), ("right", 1, 777, 0)]


def test_other_shapes_are_refused(spark):
    a = spark.range(3).toDF("k")
    for b in (a.toDF("z"), a.withColumn("m", F.lit(1)), a.select(F.col("k").cast("int").alias("k"))):
        with pytest.raises(ValueError):
            differing_rows(a, b, ["k"])
