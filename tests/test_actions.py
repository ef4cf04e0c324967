import dataclasses

from pyspark.sql import functions as F

from tablesteps.operators.order import asc, with_row_index
from tablesteps.plans.actions import any_rows, first, first_or_none, for_each, stream_rows
from tablesteps.sources.documents import to_extended_json
from tablesteps.sources.memory import from_objects, from_rows


@dataclasses.dataclass
class Person:
    ID: int
    Name: str


def test_memory_and_actions(spark):
    df = from_objects(spark, [Person(2, "b"), Person(1, "a")])
    assert df.columns == ["ID", "Name"]
    assert first(df, [asc("ID")]).Name == "a"
    assert first_or_none(df.limit(0), [asc("ID")]) is None
    assert [r.ID for r in stream_rows(df, [asc("ID")])] == [1, 2]
    assert any_rows(df) and not any_rows(df.limit(0))
    for_each(df, lambda r: None)
    assert from_rows(spark, [(1,)], "x int").count() == 1


def test_reliable_row_index(spark):
    df = spark.range(0, 1000).repartition(5)
    idx = with_row_index(df, [asc("id")])
    assert [r.row_index for r in idx.orderBy("id").collect()] == list(range(1000))


def test_extended_json(spark):
    import datetime as dt
    from decimal import Decimal

    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), Decimal("1.50"), None)], "t timestamp_ntz, d decimal(18,2), s string")
    doc = to_extended_json(df).first()[0]
    assert doc == '{"t":{"$date":"2024-01-02T03:04:05Z"},"d":{"$numberDecimal":"1.50"},"s":null}'


def test_row_helpers(spark):
    from tablesteps.operators import rows as R
    from tablesteps.sinks.jdbc import bulk_url

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    more = spark.createDataFrame([("d", 4)], "v string, k int")
    assert sorted(r.k for r in R.append_rows(df, more).collect()) == [1, 2, 3, 4]
    assert sorted(r.k for r in R.remove_at(df, 1, [asc("k")]).collect()) == [1, 3]
    assert [r.v for r in R.find_by_key(df, "K", 2).collect()] == ["b"]
    assert R.clear(df).count() == 0 and R.clear(df).columns == df.columns
    assert bulk_url("jdbc:postgresql://h/db") == "jdbc:postgresql://h/db?reWriteBatchedInserts=true"


def test_arrival_order_keep_first(spark, tmpdir_shared):
    import os

    from tablesteps.operators import rows as R
    from tablesteps.operators.order import ARRIVAL_COLUMNS, with_arrival_order

    folder = os.path.join(tmpdir_shared, "arrival")
    os.makedirs(folder)
    # two files; within each, later lines repeat earlier keys
    with open(os.path.join(folder, "a.csv"), "w") as fh:
        fh.write("k,v\n" + "".join(f"{i % 5},{i}\n" for i in range(50)))
    with open(os.path.join(folder, "b.csv"), "w") as fh:
        fh.write("k,v\n" + "".join(f"{i % 7},{100 + i}\n" for i in range(20)))
    raw = spark.read.option("header", True).schema("k int, v int").csv(folder)
    tagged = with_arrival_order(raw)
    first = R.remove_duplicates(tagged, "k", list(ARRIVAL_COLUMNS)).select("k", "v")
    got = dict((r.k, r.v) for r in first.collect())
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 105, 6: 106}


def test_pipeline_helpers(spark):
    from pyspark.sql import functions as F

    from tablesteps.functions.json_path import parse_path
    from tablesteps.plans.pipeline import Step, check_step, sequence_ops, sort_spec

    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "id int, name string")
    assert check_step(df, Step("Code", "ok", lambda d: d.select("id"))) is None
    assert "nope" in check_step(df, Step("Code", "bad", lambda d: d.select("nope")))
    ops = sequence_ops(df)
    assert ops["any"]() and ops["count"]() == 3 and ops["columns"]() == ["id", "name"] and ops["clone"]().count() == 0
    ordered = df.orderBy(*sort_spec([("name", "ASC"), ("id", "DESC")]))
    assert [r.id for r in ordered.collect()] == [3, 2, 1]
    assert parse_path("$.data.items[0][*].x") == ["data", "items", 0, "*", "x"]
