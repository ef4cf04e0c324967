"""File-drop streaming and JDBC options on embedded Derby."""

import os

import pytest
from pyspark.sql import functions as F

from tablesteps.operators.order import asc
from tablesteps.operators.validate import Validator, validate
from tablesteps.plans.pipeline import Pipeline
from tablesteps.sinks.jdbc import column_types, truncate, write_jdbc
from tablesteps.sources.csv import read_csv_stream
from tablesteps.sources.jdbc import read_jdbc
from tablesteps.sources.sql import sql_query
from tablesteps.streaming.guard import NotStreamable, check_streamable, run_stream
from tablesteps.session import shared_dir, local_path


def test_stream_csv_with_row_steps(spark, tmpdir_shared):
    inbox = os.path.join(tmpdir_shared, "inbox")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "1.csv"), "w") as fh:
        fh.write("id,email\n1,a@b.co\n2,bad\n3, c@d.io \n")
    stream = read_csv_stream(spark, inbox, "id int, email string")
    p = Pipeline(stream).filter("id > 0")
    check_streamable(p)
    checked = validate(p.plan(), Validator().column("email").email().validator, "skip")
    seen = []
    q = run_stream(checked, lambda b, i: seen.extend(r.id for r in b.collect()), "csvstream")
    q.awaitTermination(120)
    assert sorted(seen) == [1, 3]
    with pytest.raises(NotStreamable):
        check_streamable(Pipeline(stream).sort(["id"]))
    with pytest.raises(NotStreamable):
        check_streamable(Pipeline(stream, order=()).filter("id > 0").add(
            Pipeline(stream, order=(asc("id"),)).take(3).steps[0]))


def derby(spark, name):
    return f"jdbc:derby:{local_path(shared_dir(spark, name))};create=true"


def test_jdbc_write_read_truncate_atomic(spark):
    url = derby(spark, "derby-test")
    df = spark.range(0, 500).selectExpr("id", "cast(id % 7 as int) as g", "concat('n', id) as name")
    write_jdbc(df, url, "T1", mode="overwrite", dialect="derby", batch_size=100)
    back = read_jdbc(spark, url, table="T1", partition_column='"id"', num_partitions=4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 500
    filtered = back.filter(F.col("g") == 3).select("id")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(g,3)" in plan
    write_jdbc(df.limit(10), url, "T1", truncate_first=True)
    assert read_jdbc(spark, url, table="T1").count() == 10
    write_jdbc(df, url, "T1", mode="append", atomic=True)
    assert read_jdbc(spark, url, table="T1").count() == 510
    truncate(spark, url, "T1")
    assert read_jdbc(spark, url, table="T1").count() == 0
    q = read_jdbc(spark, url, query='SELECT COUNT(*) AS "n" FROM T1')
    assert q.first()[0] == 0
    assert column_types(df, "postgresql") == "`id` BIGINT, `g` INTEGER, `name` TEXT"


def test_sql_args(spark):
    df = spark.range(0, 10)
    out = sql_query(spark, "SELECT id FROM {t} WHERE id > :lo", {"lo": 6}, t=df)
    assert sorted(r.id for r in out.collect()) == [7, 8, 9]


def test_stream_validation_log_metrics(spark, tmpdir_shared):
    inbox = os.path.join(tmpdir_shared, "inbox-log")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "1.csv"), "w") as fh:
        fh.write("id,email\n1,a@b.co\n2,bad\n")
    stream = read_csv_stream(spark, inbox, "id int, email string")
    logged = validate(stream, Validator().column("email").email().validator, "log")
    rows = []
    q = run_stream(logged, lambda b, i: rows.extend(b.collect()), "logstream")
    q.awaitTermination(120)
    assert len(rows) == 2
    metrics = [p["observedMetrics"].get("validation") for p in q.recentProgress if p["observedMetrics"]]
    assert metrics and metrics[0]["invalid_rows"] == 1


def test_jdbc_bulk(spark):
    from tablesteps.sinks.jdbc import write_jdbc_bulk

    url = derby(spark, "derby-bulk")
    df = spark.range(0, 3000).selectExpr("id", "cast(id as string) as s")
    write_jdbc_bulk(df, url, "B1", mode="overwrite", dialect="derby")
    assert read_jdbc(spark, url, table="B1").count() == 3000


def test_failed_overwrite_leaves_the_target(spark):
    import pytest

    url = derby(spark, "derby-atomic")
    write_jdbc(spark.range(0, 5).selectExpr("cast(id as int) as id"), url, "A1", mode="overwrite", dialect="derby", atomic=True)
    too_large = spark.createDataFrame([(2**40,)], "id long")
    with pytest.raises(Exception):
        write_jdbc(too_large, url, "A1", mode="overwrite", dialect="derby", atomic=True)
    left = spark.read.format("jdbc").options(url=url, dbtable="A1", driver="org.apache.derby.jdbc.EmbeddedDriver").load()
    assert sorted(r[0] for r in left.collect()) == [0, 1, 2, 3, 4]


def test_upsert_into_a_table(spark):
    from tablesteps.operators.order import asc
    from tablesteps.sinks.jdbc import upsert_jdbc, upsert_statement

    url = derby(spark, "derby-upsert")
    write_jdbc(spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), url, "U1", mode="overwrite", dialect="derby")
    more = spark.createDataFrame([(2, 21, 1), (2, 22, 2), (3, 30, 1)], "k int, v int, seq int")
    last = more.selectExpr("k", "v")
    upsert_jdbc(last, url, "U1", ["k"], [asc("v")], dialect="derby")
    read = spark.read.format("jdbc").options(url=url, dbtable="U1", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(tuple(r) for r in read.load().collect()) == [(1, 10), (2, 22), (3, 30)]
    upsert_jdbc(spark.createDataFrame([(1, 99), (4, 40)], "k int, v int"), url, "U1", ["k"], [asc("v")], update=False, dialect="derby")
    assert sorted(tuple(r) for r in read.load().collect()) == [(1, 10), (2, 22), (3, 30), (4, 40)]
    assert upsert_statement("postgresql", "t", "s", ["k", "v"], ["k"], True) == (
        'INSERT INTO t ("k", "v") SELECT "k", "v" FROM s ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"'
    )


def test_long_texts_fit(spark):
    url = derby(spark, "derby-text")
    write_jdbc(spark.createDataFrame([("x" * 50_000,)], "s string"), url, "L1", mode="overwrite", dialect="derby")
    read = spark.read.format("jdbc").options(url=url, dbtable="L1", driver="org.apache.derby.jdbc.EmbeddedDriver").load()
    assert len(read.first()[0]) == 50_000


def test_bound_parameters(spark):
    import datetime as dt

    import pytest

    from tablesteps.sources.jdbc import bind, read_jdbc

    url = derby(spark, "derby-bound")
    rows = spark.createDataFrame([(1, "O'Neil", "x"), (2, "a' OR '1'='1", "y")], "id int, name string, note string")
    rows = rows.selectExpr("id", "cast(name as varchar(30)) as name")
    write_jdbc(rows, url, "P1", mode="overwrite", dialect="derby")
    text = 'SELECT "id" FROM P1 WHERE CAST("name" AS VARCHAR(40)) = :name AND "id" < :most'
    got = read_jdbc(spark, url, query=text, params={"name": "O'Neil", "most": 10}).collect()
    assert [r[0] for r in got] == [1]
    assert read_jdbc(spark, url, query=text, params={"name": "x' OR '1'='1", "most": 10}).collect() == []
    assert bind("a = ':x' AND b = :x AND c::int = :y -- :z", {"x": None, "y": dt.date(2024, 1, 2)}) == (
        "a = ':x' AND b = NULL AND c::int = DATE '2024-01-02' -- :z"
    )
    with pytest.raises(ValueError):
        bind("SELECT :nothing", {})


def test_first_per_key_across_micro_batches_with_a_time_limit(spark, tmpdir_shared):
    from tablesteps.streaming.guard import first_per_key_stream

    inbox = os.path.join(tmpdir_shared, "repeats")
    os.makedirs(inbox)
    state = shared_dir(spark, "repeats-state")
    seen = []

    def drop(name, *lines):
        with open(os.path.join(inbox, name), "w") as fh:
            fh.write("\n".join(["id,k,t", *lines]) + "\n")
        stream = read_csv_stream(spark, inbox, "id int, k string, t timestamp")
        q = run_stream(first_per_key_stream(stream, ["k"], "t", "1 hour"), lambda b, i: seen.extend(r.id for r in b.collect()), checkpoint=state)
        q.awaitTermination(120)

    drop("1.csv", "1,a,2024-01-01T00:00:00", "2,b,2024-01-01T00:10:00", "3,,2024-01-01T00:10:00")
    assert sorted(seen) == [1, 2, 3]
    drop("2.csv", "4,a,2024-01-01T00:20:00", "5,c,2024-01-01T00:20:00", "6,,2024-01-01T00:30:00")
    assert sorted(seen) == [1, 2, 3, 5]  # repeats in a later file, after a restart, go
    drop("3.csv", "7,d,2024-01-01T06:00:00")
    drop("4.csv", "8,a,2024-01-01T06:10:00")
    assert sorted(seen) == [1, 2, 3, 5, 7, 8]  # the limit is over: the key is new again
    with pytest.raises(ValueError):
        first_per_key_stream(spark.range(3), ["id"], "id", "1 hour")


def test_stream_and_batch_read_the_same_rows(spark, tmpdir_shared):
    """Trimming, blank lines, empty cells and conversion are those of ``read_csv``; a file of another header fails."""
    from tablesteps.sources.csv import read_csv

    inbox, out = os.path.join(tmpdir_shared, "same-in"), os.path.join(tmpdir_shared, "same-out")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write('id,name,flag,price\n 1 ,"  quoted \t",TRUE,1.5\n\n   \n2,,false, 2.25 \n3,"two\nlines",True,\n')
    schema = "id long, name string, flag boolean, price double"
    stream = read_csv_stream(spark, inbox, schema)
    run_stream(stream, lambda df, _i: df.write.mode("append").parquet(out), "same-rows").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    batch = read_csv(spark, inbox, schema={"id": "bigint", "name": "string", "flag": "boolean", "price": "double"})
    assert got == sorted(map(tuple, batch.collect()))
    assert got == [(1, "quoted", True, 1.5), (2, None, False, 2.25), (3, "two\nlines", True, None)]
    with open(os.path.join(inbox, "b.csv"), "w", encoding="utf-8") as fh:
        fh.write("name,id,flag,price\nx,4,true,1\n")
    again = run_stream(read_csv_stream(spark, inbox, schema), lambda df, _i: df.collect(), "same-rows-again")
    with pytest.raises(Exception, match="(?i)header"):
        again.awaitTermination()
