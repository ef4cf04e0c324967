"""Range joins, latest-before lookups and exact quantiles against brute force."""

import math
import random

import pytest

from tablesteps.operators import ranges as R


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, seed, how):
    rng = random.Random(seed)
    points = [(i, rng.choice([None, 0.0, -5.0, 7.25, rng.uniform(-50, 50), rng.uniform(-1e6, 1e6), 2.0 ** rng.randint(-4, 6)])) for i in range(120)]
    bands = [(1000, None, 3.0), (1001, 3.0, None), (1002, 4.0, 3.0), (1003, float("-inf"), 1.0), (1004, 7.25, 7.25), (1005, -1e6, 1e6)]
    for i in range(60):
        low = rng.choice([p for _, p in points if p is not None])
        bands.append((i, low, low + rng.choice([0.0, 1e-7, 0.5, 1.0, 2.0, 8.0, 1000.0, rng.uniform(0, 40)])))
    p = spark.createDataFrame(points, "id long, `x.y` double")
    b = spark.createDataFrame(bands, "id long, low double, high double")
    want = [(*u, *v) for u in points for v in bands if None not in (u[1], *v) and v[1] <= u[1] <= v[2]]
    if how == "left":
        want += [(*u, None, None, None) for u in points if u[0] not in {w[0] for w in want}]
    out = R.range_join(p, b, "x.y", "low", "high", how=how)
    assert out.columns == ["id", "x.y", "id", "low", "high"]
    assert rows_of(out) == sorted(want, key=repr)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        R.range_join(p, b, "x.y", "low", "high", how="full")


def test_range_join_of_empty_tables_and_times_without_zone(spark):
    p = spark.sql("SELECT 1 AS a, timestamp_ntz'2024-03-31 02:30:00' AS t UNION ALL SELECT 2, timestamp_ntz'2024-03-31 03:00:00'")
    b = spark.sql("SELECT timestamp_ntz'2024-03-31 02:00:00' AS lo, timestamp_ntz'2024-03-31 02:45:00.5' AS hi")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 does not exist there
    try:
        assert [r.a for r in R.range_join(p, b, "t", "lo", "hi").collect()] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert R.range_join(p.limit(0), b, "t", "lo", "hi").collect() == []
    assert R.range_join(p, b.limit(0), "t", "lo", "hi").collect() == []
    assert len(R.range_join(p, b.limit(0), "t", "lo", "hi", how="left").collect()) == 2


@pytest.mark.parametrize("parts", [1, 13])
def test_latest_before_with_a_key_over_many_partitions(spark, parts):
    rng = random.Random(parts)
    key = lambda: rng.choice([0, 0, 0, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(40)]), i, rng.choice([None, f"v{i}"])) for i in range(90)]
    want = []
    for i, k, t in left:
        held = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and r[1] <= t]
        best = max(held, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((i, k, t, best[2], best[3]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = R.latest_before(
            spark.createDataFrame(left, "id long, k long, t int"), spark.createDataFrame(right, "key long, at long, no long, v string"),
            [("k", "key")], "t", "at", ["no"], ["no", "v"],
        )
        assert out.columns == ["id", "k", "t", "no", "v"] and rows_of(out) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_quantiles_of_groups(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1.0, -2.5, rng.gauss(0, 1), rng.gauss(0, 1e9), 1e300, -1e300, 5e-324])
    rows = [(rng.choice([None, "a", "a", "a", "b"]), value()) for _ in range(600)] + [("one", 3.0), ("none", None)]
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    want = [(k, q, sorted(v)[max(math.ceil(len(v) * q), 1) - 1], len(v)) for k, v in groups.items() for q in qs]
    df = spark.createDataFrame(rows, "`k.x` string, n double")
    for bins in (4, 1024):
        out = R.group_quantiles(df, ["k.x"], "n", qs, bins=bins)
        assert out.columns == ["k.x", "q", "value", "n"] and rows_of(out) == sorted(want, key=repr)
    every = sorted(v for _, v in rows if v is not None)
    assert rows_of(R.group_quantiles(df, [], "n", [0.5])) == [(0.5, every[math.ceil(len(every) * 0.5) - 1], len(every))]
    assert R.group_quantiles(df.limit(0), ["k.x"], "n", [0.5]).collect() == []
    with pytest.raises(ValueError):
        R.group_quantiles(df, ["k.x"], "n", [1.5])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_bucket_is_cut_into_tiles(spark, monkeypatch, how):
    """Equal points in equal intervals, all in one bucket: no task has most of the pairs."""
    monkeypatch.setattr(R, "TILE", 16)
    monkeypatch.setattr(R, "TASK_PAIRS", 1000)
    p = spark.sql("SELECT id AS a, IF(id < 300, 5.0D, id * 10.0D) AS x, cast(id % 2 AS int) AS k FROM range(320)").repartition(1)
    b = spark.sql("SELECT id AS b, 4.5D AS lo, 5.5D AS hi, id % 2 AS j FROM range(200) UNION ALL SELECT 999, 3000.0D, 3000.0D, 0").repartition(1)
    for on in ([], [("k", "j")]):
        out = R.range_join(p, b, "x", "lo", "hi", on=on, how=how)
        want = [(a, c) for a in range(300) for c in range(200) if not on or a % 2 == c % 2] + [(300, 999)]
        want += [(a, None) for a in range(301, 320)] if how == "left" else []
        assert sorted(((r.a, r.b) for r in out.select("a", "b").collect()), key=repr) == sorted(want, key=repr)
        if how == "inner":
            sizes = [r["count"] for r in out.groupBy(R.F.spark_partition_id()).count().collect()]
            assert len(sizes) > 4 and max(sizes) < sum(sizes) / 3
