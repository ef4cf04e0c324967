"""Validation and upsert fixtures (FIXTURES §4, §5), column laws, pipelines."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tablesteps.operators import rows as R
from tablesteps.operators import upsert as U
from tablesteps.operators.compare import difference_counts, ordered_difference, tables_equivalent
from tablesteps.operators.order import asc
from tablesteps.operators.validate import Validator, error_table, validate, validate_with_results
from tablesteps.plans.pipeline import Pipeline, describe
from tablesteps.functions.typed import conform, unique_names
from tablesteps.functions.text import net_number

VALID = [
    (1, "a@b.co", "30", "A", 1.0),
    (2, None, "30", "A", 1.0),
    (3, "  ", "30", "A", 1.0),
    (4, "bad", "200", "B", 1.0),
    (5, "a@b.co", "abc", "B", 1.0),
    (6, "a@b.co", None, "ZZZZ", None),
]


def rules():
    return (
        Validator()
        .column("email").required().email()
        .column("age").range(0, 120)
        .column("code").is_in(["A", "B"]).min_length(1).max_length(3)
        .validator
    )


@pytest.fixture(scope="module")
def vt(spark):
    return spark.createDataFrame(VALID, "id int, email string, age string, code string, qty double")


def test_validation_fixture(vt):
    got = {r.id: r.summary for r in validate_with_results(vt, rules()).collect()}
    assert got[1] == "Valid"
    assert got[2] == "email: Field is required"
    assert got[3] == "email: Field is required; email: Invalid email format"
    assert got[4] == "email: Invalid email format; age: Value must be between 0 and 120"
    assert got[5] == "age: Value must be numeric"
    assert got[6] == "code: Value must be one of: A, B; code: Maximum length is 3 characters"


def test_modes(vt):
    assert [r.id for r in validate(vt, rules(), "skip").collect()] == [1]
    obs = Observation("v")
    kept = validate(vt, rules(), "log", obs)
    assert kept.count() == 6
    assert obs.get["invalid_rows"] == 5 and obs.get["errors"] == 8
    assert obs.get["rule_0_email_required"] == 2 and obs.get["rule_1_email_email"] == 2
    assert obs.get["rule_2_age_range"] == 2 and obs.get["rule_5_code_max_length"] == 1
    with pytest.raises(PySparkException, match="Validation failed"):
        validate(vt, rules(), "throw").collect()
    fixed = validate(vt, Validator().column("age").range(0, 120, fix=F.lit("0")).validator, "fix")
    assert {r.id: r.age for r in fixed.collect()} == {1: "30", 2: "30", 3: "30", 4: "0", 5: "0", 6: None}
    errs = error_table(vt, rules(), ["id"])
    assert errs.count() == 8


def test_keep_plus_drop_is_input(vt):
    res = validate_with_results(vt, rules())
    assert res.filter("is_valid").count() + res.filter("not is_valid").count() == vt.count()


def test_type_and_not_in_rules(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    v = Validator().column("v").of_type("int").not_in(["x"]).validator
    got = {r.v: r.summary for r in validate_with_results(df, v).collect()}
    assert got["x"] == "v: Value must be of type Int32; v: Value must not be one of: x"
    assert got["1"] == "Valid" and got[None] == "Valid"
    n = spark.createDataFrame([(1,), (2,)], "n int")
    strict = Validator().column("n").is_in(["1", 2]).validator  # type-strict: "1" never equals 1
    assert {r.n: r.is_valid for r in validate_with_results(n, strict).collect()} == {1: False, 2: True}


def test_net_number():
    assert net_number(0) == "0" and net_number(120.0) == "120" and net_number(1.5) == "1.5"
    assert net_number(1e16) == "1E+16"


@pytest.fixture(scope="module")
def pair(spark):
    target = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, a string, b string")
    source = spark.createDataFrame([(2, "m", 0), (3, "n", 1), (3, "o", 2), (None, "z", 3)], "k int, a string, seq int")
    return target, source


def kab(df):
    return sorted(((r.k, r.a, r.b) for r in df.collect()), key=repr)


def test_upsert_do_nothing(pair):
    t, s = pair
    out = U.upsert_do_nothing(t, s, ["k"], [asc("seq")]).select("k", "a", "b")
    assert kab(out) == sorted([(1, "x", "p"), (2, "y", "q"), (3, "n", None), (None, "z", None)], key=repr)


def test_upsert_update(pair):
    t, s = pair
    out = U.upsert_update(t, s, ["k"], [asc("seq")]).select("k", "a", "b")
    assert kab(out) == sorted([(1, "x", "p"), (2, "m", "q"), (3, "o", None), (None, "z", None)], key=repr)


def test_upsert_replace(pair):
    t, s = pair
    out = U.upsert_replace(t, s, "k", [asc("seq")]).select("k", "a", "b")
    assert kab(out) == sorted([(1, "x", "p"), (2, "m", None), (3, "o", None), (None, "z", None)], key=repr)


def test_upsert_idempotent(pair):
    t, s = pair
    s = s.filter("k is not null")  # null keys never conflict, so they insert every time
    once = U.upsert_update(t, s, ["k"], [asc("seq")])
    twice = U.upsert_update(once, s, ["k"], [asc("seq")])
    assert tables_equivalent(once, twice)


def test_column_laws(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, Name string, City string")
    assert R.remove_column(df, "NAME").columns == ["id", "City"]
    assert R.remove_column(df, "absent").columns == df.columns
    assert R.add_column(df, "name", F.lit("z")).columns == df.columns
    assert R.add_column(df, "name", F.lit("z")).first()["Name"] == "z"
    r = R.rename_column(df, "name", "City")
    assert r.columns == ["id", "City"] and r.first()["City"] == "b"
    r2 = R.rename_column(df, "city", "name")
    assert r2.columns == ["id", "Name"] and r2.first()["Name"] == "b"
    assert R.rename_column(df, "absent", "x").columns == df.columns
    f = R.fill_missing(spark.createDataFrame([(None,), ("",)], "v string"), "v", "d")
    assert sorted(r.v for r in f.collect()) == ["", "d"]
    assert R.fill_missing(df, "new", 5).columns == ["id", "Name", "City", "new"]
    with pytest.raises(ValueError):
        R.take(df, -1, [asc("id")])
    with pytest.raises(ValueError):
        R.batch_ids(df, 0, [asc("id")])
    with pytest.raises(ValueError):
        R.take(df, 1, None)


def test_conform_and_unique_names(spark):
    assert unique_names(["a", "A", "b", "a"]) == ["a", "A_1", "b", "a_2"]
    df = spark.createDataFrame([("1", "0", "2024-01-02"), ("x", "true", "bad")], "n string, b string, d string")
    out = conform(df, {"n": "int", "b": "boolean", "d": "timestamp_ntz"}).collect()
    assert [(r.n, r.b) for r in out] == [(1, False), (None, True)]
    assert out[1].d is None and out[0].d.year == 2024


def test_compare(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "K int, V string")
    r = difference_counts(a, b).first()
    assert (r.rows_left, r.rows_right, r.only_left, r.only_right, r.equivalent) == (3, 3, 1, 1, False)
    assert tables_equivalent(a, a)
    od = ordered_difference(a, b, [asc("k")], [asc("K")]).first()
    assert od.rows_compared == 3


def test_pipeline_step_log_and_failed_step(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    p = (
        Pipeline(df, source_name="t")
        .filter("k >= 10", title="drop first ten")
        .code("-- bad column\nSELECT nope FROM {data}", title="broken")
        .code("SELECT k, k * 2 AS k2 FROM {data}", title="double")
    )
    report = p.run()
    assert report.success
    log = {r.step: r for r in report.step_log(spark).collect()}
    assert log[0].kind == "Import" and log[0].rows_out == 100
    assert (log[1].rows_in, log[1].rows_out) == (100, 90)
    assert log[2].error and log[2].description == "bad column"
    assert log[3].rows_out == 90 and log[3].description.startswith("SELECT k, k * 2")
    assert p.remove(0).plan().count() == 100  # removing a step removes its effect
    assert describe("") == "Empty transformation"
    assert describe("x" * 100) == "x" * 77 + "..."


def test_pipeline_order_chain(spark):
    df = spark.createDataFrame(
        [(1, "b", 2), (2, "a", 2), (3, "b", 1), (4, "a", 1), (5, "a", 1)], "id int, s string, n int"
    )
    p = Pipeline(df, order=(asc("id"),)).order_by("s").order_by("n")
    assert [r.id for r in p.plan().collect()] == [4, 5, 3, 2, 1]
    assert [r.id for r in p.take(2).plan().collect()] == [4, 5]
    assert sorted(r.id for r in p.skip(3).plan().collect()) == [1, 2]
    assert sorted(r.id for r in p.remove_duplicates("s").plan().collect()) == [3, 4]
    assert [r.id for r in Pipeline(df, order=(asc("id"),)).order_by_desc("n").take(1).plan().collect()] == [1]
    with pytest.raises(ValueError):
        Pipeline(df).take(1)
    report = p.batch(2).run(sink=lambda d: d.write.format("noop").mode("overwrite").save())
    log = report.step_log(spark).collect()
    assert log[-1].kind == "Export" and log[-1].rows_in == 5


def test_run_without_counts(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "k")
    report = Pipeline(df).filter("k < 10").run(counts=False)
    assert report.success and report.counts == [None, None]
    assert len(report.step_log(spark).collect()) == 2


def test_upsert_null_keys_insert(pair):
    t, s = pair
    up = U.upsert_update(t, s, ["k"], [asc("seq")]).select("k", "a", "b")
    assert kab(up) == sorted([(1, "x", "p"), (2, "m", "q"), (3, "o", None), (None, "z", None)], key=repr)
    dn = U.upsert_do_nothing(t, s, ["k"], [asc("seq")]).select("k", "a", "b")
    assert kab(dn) == sorted([(1, "x", "p"), (2, "y", "q"), (3, "n", None), (None, "z", None)], key=repr)
    rp = U.upsert_replace(t, s, "k", [asc("seq")]).select("k", "a", "b")
    assert kab(rp) == sorted([(1, "x", "p"), (2, "m", None), (3, "o", None), (None, "z", None)], key=repr)


def job_count(spark, build):
    """Spark jobs that building a plan starts."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "plan")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_runs_no_job(spark):
    from tablesteps.operators import rows as R
    from tablesteps.operators.join import join_step

    t = spark.range(0, 5000, 1, 3).selectExpr("id as k", "cast(id as string) as a")
    s = spark.createDataFrame([(3, "z", 1), (9999, "n", 1)], "k long, a string, seq int")
    order = [asc("seq")]
    assert job_count(spark, lambda: U.upsert_update(t, s, ["k"], order)) == 0
    assert job_count(spark, lambda: U.upsert_do_nothing(t, s, ["k"], order)) == 0
    assert job_count(spark, lambda: U.upsert_replace(t, s, "k", order)) == 0
    assert job_count(spark, lambda: U.upsert_predicate(t, s, [("k", "k")], [asc("k")], order)) == 0
    assert job_count(spark, lambda: R.flat_map(t, "split(a, '1')", "x")) == 0
    assert job_count(spark, lambda: join_step(t, s, ["k"], "left", broadcast_side=True)) == 0


def test_upserts_scan_each_side_a_few_times(spark, tmp_path):
    spark.range(0, 50).selectExpr("id as k", "cast(id as string) as a").write.parquet(str(tmp_path / "t"))
    spark.range(40, 90).selectExpr("id as k", "'z' as a", "1 as seq").write.parquet(str(tmp_path / "s"))
    t, s = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "s"))
    for out, most in (
        (U.upsert_update(t, s, ["k"], [asc("seq")]), 3),
        (U.upsert_do_nothing(t, s, ["k"], [asc("seq")]), 3),
        (U.upsert_replace(t, s, "k", [asc("seq")]), 5),  # the key columns of the source once more
        (U.upsert_predicate(t, s, [("k", "k")], [asc("k")], [asc("seq")]), 4),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("Relation [") <= most
        assert out.count() == 90


def test_many_null_keys_all_insert(spark):
    t = spark.createDataFrame([(None, "t"), (1, "t")], "k long, a string")
    s = spark.createDataFrame([(None, f"s{i}", i) for i in range(50)] + [(1, "x", 1)], "k long, a string, seq int")
    assert U.upsert_update(t, s, ["k"], [asc("seq")]).count() == 52
    assert U.upsert_do_nothing(t, s, ["k"], [asc("seq")]).count() == 52
    assert U.upsert_predicate(t, s, [("k", "k")], [asc("a")], [asc("seq")]).count() == 52


def test_custom_aggregate_salted_path(spark):
    import pandas as pd

    from tablesteps.operators.grouping import custom_aggregate

    rows = [("hot" if i % 3 else "cold", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)

    def partial(pdf):
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "s": [pdf["v"].sum()], "n": [len(pdf)]})

    def merge(pdf):
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "mean": [pdf["s"].sum() / pdf["n"].sum()]})

    out = {r.k: r.mean for r in custom_aggregate(df, ["k"], partial, "k string, s double, n long", merge, "k string, mean double").collect()}
    hot = [v for k, v in rows if k == "hot"]
    cold = [v for k, v in rows if k == "cold"]
    assert out == {"hot": sum(hot) / len(hot), "cold": sum(cold) / len(cold)}


def test_vectorized_aggregate_null_and_large_keys(spark):
    import pandas as pd

    from tablesteps.operators.grouping import custom_aggregate

    big = 2**60
    rows = [(None, 2.0), (None, 3.0), (big, 1.0), (big + 1, 5.0)] * 50
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)

    def partial(pdf):
        return pdf.groupby("k", dropna=False).agg(s=("v", "sum")).reset_index()

    def combine(pdf):
        return pdf.groupby("k", dropna=False).agg(s=("s", "sum")).reset_index()

    out = custom_aggregate(df, ["k"], partial, "k long, s double", combine, "k long, s double", combine=combine, vectorized=True)
    assert {r.k: r.s for r in out.collect()} == {None: 250.0, big: 50.0, big + 1: 250.0}


def test_any_step_error_is_logged(spark):
    from tablesteps.plans.pipeline import Pipeline

    def broken(df):
        raise KeyError("oops")

    p = Pipeline(spark.range(5), order=(asc("id"),)).remove_duplicates("nothing").code(broken).filter("id > 1")
    report = p.run()
    assert report.success and report.counts[0] == 5 and report.counts[-1] == 3 and report.failed == 2
    assert "nothing" in report.step_errors[0] and "oops" in report.step_errors[1]
    log = report.step_log(spark).collect()
    assert all(r.millis is not None for r in log[1:4])


def test_names_with_dots_and_duplicates(spark):
    from tablesteps.functions.typed import conform
    from tablesteps.operators import grouping as G
    from tablesteps.operators import rows as R

    df = spark.createDataFrame([(1, None, "x y"), (2, 5, "z")], "`a.b` int, `c.d` int, `t.x` string")
    order = [asc("`a.b`")]
    assert R.remove_column(df, "c.d").columns == ["a.b", "t.x"]
    assert [r[1] for r in R.fill_missing(df, "c.d", 7).orderBy("`a.b`").collect()] == [7, 5]
    assert R.project(df, "a.b", n="`c.d`").columns == ["a.b", "n"]
    assert R.flat_map(df, "split(`t.x`, ' ')", "w", keep=["a.b"]).count() == 3
    assert R.rename_column(df, "a.b", "e.f").columns == ["e.f", "c.d", "t.x"]
    assert R.remove_duplicates(df, "a.b", order).count() == 2
    assert R.skip(df, 1, order).columns == df.columns
    assert R.find_by_key(df, "a.b", 2).count() == 1
    assert G.aggregate(df, "a.b", n=F.count("*")).columns == ["a.b", "n"]
    assert G.group_rows(df, "a.b", order).count() == 2
    assert difference_counts(df, df).first()["equivalent"]
    src = df.withColumn("seq", F.lit(1))
    assert U.upsert_update(df, src, ["a.b"], [asc("seq")]).columns == df.columns
    assert U.upsert_do_nothing(df, src, ["a.b"], [asc("seq")]).count() == 2
    assert U.upsert_replace(df, src, "a.b", [asc("seq")]).count() == 2
    assert U.upsert_predicate(df, src, [("a.b", "a.b")], [asc("a.b")], [asc("seq")]).count() == 2
    twice = df.select("`a.b`", F.col("`a.b`").cast("string"), F.col("`c.d`").alias("A.B"))
    assert conform(twice, {"a.b": "int"}).dtypes[0] == ("a.b", "int") and len(conform(twice, {}).columns) == 3


def test_stream_guard_refuses_hidden_state(spark, tmp_path):
    from tablesteps.streaming.guard import NotStreamable, check_stateless

    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    check_stateless(stream.filter("id > 1"))
    for bad in (stream.distinct(), stream.groupBy("id").count()):
        with pytest.raises(NotStreamable):
            check_stateless(bad)


def test_partials_sorted_by_key_merge_a_batch_at_a_time(monkeypatch):
    import random

    import pandas as pd

    from tablesteps.operators import grouping

    monkeypatch.setattr(grouping, "COMBINE_ROWS", 20)
    rng = random.Random(5)
    keys = sorted((rng.choice([None, 1, 2, 3, 4, 40, 41]) for _ in range(400)), key=lambda k: (k is not None, k or 0))
    frame = pd.DataFrame({"k": pd.array(keys, "Int64"), "j": ["x"] * 400, "s": range(400)})
    held = []

    def combine(pdf):
        held.append(len(pdf))
        return pdf.groupby(["k", "j"], dropna=False, as_index=False)["s"].sum()

    cuts = [0, 1, 1, 30, 31, 90, 97, 180, 260, 399, 400]
    batches = (frame.iloc[a:b] for a, b in zip(cuts, cuts[1:]))
    out = pd.concat(grouping._merged_by_key(batches, ["k", "j"], combine, lambda p: p.groupby(["k", "j"], dropna=False, as_index=False)["s"].sum()))
    expected = frame.groupby(["k", "j"], dropna=False)["s"].sum()
    assert len(out) == 7 and sorted(out["s"]) == sorted(expected)
    assert held and max(held) <= 150  # a key's waiting rows, never the whole partition


def test_a_failed_run_reports_what_finished_tasks_counted(spark):
    from tablesteps.plans.pipeline import Pipeline

    late = F.when(F.col("id") > 900, F.raise_error(F.lit("late"))).otherwise(F.col("id"))
    p = Pipeline(spark.range(0, 1000, 1, 4)).filter("id % 2 = 0").code(lambda df: df.withColumn("v", late))
    report = p.run()
    assert not report.success and "late" in report.error
    # Three of four tasks finished, or fewer when the failing one ended the job before them.
    assert report.counts[0] in (None, 0, 250, 500, 750)
    assert report.counts[0] is None or report.counts[1] == report.counts[0] / 2

    def no_job(df):
        raise OSError("no such sink")

    never = Pipeline(spark.range(10)).filter("id > 3").run(sink=no_job)
    assert not never.success and never.counts == [None, None] and never.failed == 1
    assert never.step_log(spark).count() == 2
