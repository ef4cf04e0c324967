"""JSON shapes and paths, REST envelopes and pages and documents."""

import json
import os
import zipfile

import pytest
from pyspark.sql import types as T

from tablesteps.sources.documents import find, read_documents
from tablesteps.sources.json import read_json, read_json_lines
from tablesteps.sources.rest import HttpError, envelope_items, last_page, page_ranges, page_requests, read_pages, read_rest
from tablesteps.sinks.rest import api_payloads, send_payloads
from tablesteps.operators.order import asc


def put(folder, name, text):
    p = os.path.join(folder, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_json_document_shapes(spark, tmpdir_shared):
    arr = put(tmpdir_shared, "arr.json", '[{"a":1},{"a":2,"b":[1]}]')
    df = read_json(spark, arr)
    assert df.count() == 2 and set(df.columns) == {"a", "b"}
    obj = put(tmpdir_shared, "obj.json", '{"a":1} ')
    assert read_json(spark, obj).count() == 1


def test_json_path(spark, tmpdir_shared):
    p = put(tmpdir_shared, "p.json", '{"data":{"items":[{"a":1},{"a":2}]}}')
    assert [r.a for r in read_json(spark, p, path_expr="$.data.items[0]").collect()] == [1]
    assert sorted(r.a for r in read_json(spark, p, path_expr="$.data.items[*]").collect()) == [1, 2]
    assert read_json(spark, p, path_expr="$.nope").count() == 0


def test_json_lines(spark, tmpdir_shared):
    p = put(tmpdir_shared, "l.jsonl", '{"a":1}\n{"a":2}\n')
    assert read_json_lines(spark, p).count() == 2


def test_envelopes():
    assert len(envelope_items('[{"a":1},{"a":2}]')) == 2
    assert len(envelope_items('{"data":[{"a":1}]}')) == 1
    assert len(envelope_items('{"results":[{"a":1},{"a":2},{"a":3}]}')) == 3
    assert len(envelope_items('{"items":[{"a":1}]}')) == 1
    assert envelope_items('{"a":1}') == [{"a": 1}]


def test_rest_single_body_types(spark, tmpdir_shared):
    put(tmpdir_shared, "api/body/x.json", '[{"a":{"b":1},"n":2,"x":1.5,"s":"t","f":true},{"n":3,"x":2}]')
    df = read_rest(spark, "file://" + os.path.join(tmpdir_shared, "api"), transport="file")
    types = {f.name: f.dataType for f in df.schema.fields}
    assert df.columns == ["a", "n", "x", "s", "f"]
    assert isinstance(types["n"], T.LongType) and isinstance(types["x"], T.DoubleType)
    first = [r for r in df.collect() if r.n == 2][0]
    assert json.loads(first.a) == {"b": 1}


def test_rest_pages_and_failing_page(spark, tmpdir_shared):
    base = os.path.join(tmpdir_shared, "pages")
    for i in range(1, 4):
        put(tmpdir_shared, f"pages/page={i}/b.json", json.dumps([{"id": i * 10 + j} for j in range(2)]))
    df = read_rest(spark, "file://" + base, pageSize=2, stripes=2, transport="file", retryDelay=0)
    assert sorted(r.id for r in df.collect()) == [10, 11, 20, 21, 30, 31]
    put(tmpdir_shared, "pages/page=2/status", "500")
    with pytest.raises(Exception, match="failed after"):
        read_rest(spark, "file://" + base, pageSize=2, stripes=1, transport="file", retryDelay=0, retries=2).collect()


def test_last_page_by_galloping():
    for n in range(0, 200):
        held, asked = last_page(lambda page, n=n: page > n)
        assert held == n and len(asked) == len(set(asked)) == (2 * n.bit_length() if n else 1)
        for count in (1, 3, 8, 500):
            ranges = page_ranges(n, count)
            assert [p for a, b in ranges for p in range(a, b + 1)] == list(range(1, n + 1))
            sizes = [b - a + 1 for a, b in ranges]
            assert len(ranges) <= count and (not sizes or max(sizes) - min(sizes) <= 1)


def test_rest_pages_asked(spark, tmpdir_shared):
    base = os.path.join(tmpdir_shared, "asked")
    uri, options = "file://" + base, {"pageSize": 1, "stripes": 3, "transport": "file", "retryDelay": 0}
    os.makedirs(base, exist_ok=True)
    assert read_rest(spark, uri, **options).count() == 0
    for i in range(1, 12):
        put(tmpdir_shared, f"asked/page={i}/b.json", json.dumps([{"id": i}]))
    raw = read_pages(spark, uri, **options)
    assert tuple(page_requests(raw).first()) == (11, 11, 8, 11)
    assert raw.filter("item_index >= 0").rdd.getNumPartitions() == 4  # what was probed, and three ranges
    known = read_pages(spark, uri, pages=11, **options)
    assert tuple(page_requests(known).first()) == (11, 11, 0, 11)
    # A page that is empty by the time it is read ends the table, whichever task reads it.
    put(tmpdir_shared, "asked/page=6/b.json", "[]")
    assert sorted(r.id for r in read_rest(spark, uri, pages=11, **options).collect()) == [1, 2, 3, 4, 5]
    assert tuple(page_requests(read_pages(spark, uri, pages=11, **options)).first()) == (10, 11, 0, 10)


def test_rest_sink_batches(spark, tmpdir_shared):
    df = spark.range(0, 250).withColumnRenamed("id", "k")
    payloads = api_payloads(df, [asc("k")], 100)
    out = send_payloads(payloads, "file://" + os.path.join(tmpdir_shared, "sent"), transport="file", run_id="load")
    res = sorted((r.batch_id, r.n_rows, r.status) for r in out.collect())
    assert res == [(0, 100, 200), (1, 100, 200), (2, 50, 200)]
    sent = sorted(os.listdir(os.path.join(tmpdir_shared, "sent")))
    assert sent == ["load-batch-000000000.json", "load-batch-000000001.json", "load-batch-000000002.json"]


def test_documents(spark, tmpdir_shared):
    p = put(
        tmpdir_shared,
        "docs.jsonl",
        '{"_id":{"$oid":"65a"},"n":{"$numberDecimal":"1.5"},"t":{"$date":"2024-01-02T03:04:05Z"},"sub":{"x":1},"arr":[1,2]}\n'
        '{"_id":{"$oid":"65b"},"n":{"$numberDecimal":"2"},"t":{"$date":"2024-01-03T00:00:00Z"},"sub":{"x":2},"arr":[]}\n',
    )
    df = read_documents(spark, p)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["_id"], T.StringType) and isinstance(types["n"], T.StringType)
    assert isinstance(types["t"], T.TimestampNTZType) and isinstance(types["sub"], T.StructType)
    got = find(df, where={"sub.x": 2}, project=["n", "sub.x"]).collect()
    assert [tuple(r) for r in got] == [("2", 2)]
    paged = find(df, sort=("_id", -1), skip=1, limit=1, project=["_id"]).collect()
    assert [r._id for r in paged] == ["65a"]


def test_retry_policy(monkeypatch):
    from tablesteps.sources import rest

    sleeps, calls = [], []
    monkeypatch.setattr(rest.time, "sleep", lambda s: sleeps.append(s))

    def flaky(url, headers):
        calls.append(url)
        return (503, "") if len(calls) < 3 else (200, "[]")

    assert rest.request_with_retry(flaky, "u", {}, 3, 1.0) == "[]"
    assert sleeps == [1.0, 2.0]  # delay x attempt
    calls.clear()
    sleeps.clear()
    with pytest.raises(rest.HttpError):
        rest.request_with_retry(lambda u, h: (500, ""), "u", {}, 3, 0.5)
    assert sleeps == [0.5, 1.0]
    assert rest.page_url("http://h/x", 2, 10, "page", "pageSize") == "http://h/x?page=2&pageSize=10"
    assert rest.page_url("http://h/x?a=1", 1, 5, "p", "s") == "http://h/x?a=1&p=1&s=5"


def test_document_dates_ignore_session_zone(spark, tmpdir_shared):
    import datetime as dt

    p = put(tmpdir_shared, "tz.jsonl", '{"t":{"$date":"2024-01-02T03:04:05Z"}}\n{"t":{"$date":1704164645000}}\n')
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        got = [r.t for r in read_documents(spark, p).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 2


def test_json_mixed_array(spark, tmpdir_shared):
    p = put(tmpdir_shared, "mixed.json", '[{"a":1}, 5, {"a":2,"b":"x"}]')
    rows = read_json(spark, p, mixed=True).collect()
    assert sorted((r.a, r.b) for r in rows if r.a is not None) == [(1, None), (2, "x")]
    assert sum(1 for r in rows if r.a is None and r.b is None) == 1  # the scalar: an empty row


def test_document_query_builder(spark):
    from tablesteps.sources.documents import DocumentQuery

    coll = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(10)], "_id long, g long, name string")
    q = DocumentQuery().where("g", 0).where("g", 1).sort("_id", -1).skip(1).limit(2).project("name")
    assert [r.name for r in q.run(coll).collect()] == ["n4", "n1"]
    assert q.run(coll).columns == ["name"]


def test_files_helpers(spark, tmpdir_shared):
    from tablesteps.sources import files as FS

    assert FS.s3_uri("b", "/k/x.csv") == "s3a://b/k/x.csv"
    assert FS.azure_uri("acct", "cont", "p/x.csv") == "abfss://cont@acct.dfs.core.windows.net/p/x.csv"
    assert FS.gcs_uri("b", "x.csv") == "gs://b/x.csv"
    assert FS.object_store_settings("s3", access_key="a", region="r") == {
        "fs.s3a.access.key": "a",
        "fs.s3a.endpoint.region": "r",
    }
    put(tmpdir_shared, "objs/a.txt", "hello\nworld")
    put(tmpdir_shared, "objs/sub/b.txt", "x")
    listing = FS.list_objects(spark, os.path.join(tmpdir_shared, "objs")).collect()
    assert sorted(os.path.basename(r.path) for r in listing) == ["a.txt", "b.txt"]
    text = FS.read_text_object(spark, os.path.join(tmpdir_shared, "objs", "a.txt")).first()
    assert text.text == "hello\nworld"
    with pytest.raises(ValueError):
        FS.kind_of("x.parquet")


def test_read_any_dispatch(spark, tmpdir_shared):
    from tablesteps.sources.files import read_any

    p = put(tmpdir_shared, "any/t.jsonl", '{"a":1}\n{"a":2}\n')
    assert read_any(spark, p).count() == 2


def test_json_comments_and_object_file(spark, tmpdir_shared):
    import glob

    from tablesteps.operators.order import desc
    from tablesteps.sinks.files import write_json_object

    p = put(tmpdir_shared, "c.json", '/* header */\n[{"a": 1}, // one\n {"a": 2}]')
    assert sorted(r.a for r in read_json(spark, p).collect()) == [1, 2]
    out = os.path.join(tmpdir_shared, "obj")
    write_json_object(spark.range(0, 10), out, [desc("id")])
    text = open(glob.glob(out + "/part-*")[0]).read().strip()
    assert json.loads(text) == {"id": 9}


def test_indexed_sorted(spark):
    from tablesteps.operators.order import indexed_sorted

    df = spark.createDataFrame([(3,), (1,), (2,)], "x int").repartition(2)
    assert [(r.x, r.row_index) for r in indexed_sorted(df, [asc("x")]).collect()] == [(1, 0), (2, 1), (3, 2)]




def test_select_path_past_the_end_and_other_errors(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from tablesteps.functions.json_path import select_path

    df = spark.sql("SELECT array(named_struct('x', 1)) AS items UNION ALL SELECT array()")
    assert [r.x for r in select_path(df, "$.items[0]").collect()] == [1]
    assert select_path(df, "$.items[3]").collect() == []
    assert select_path(df, "$.nothing.here").collect() == []
    with pytest.raises(AnalysisException):
        select_path(spark.sql("SELECT 1 AS n"), "$.n[*]")


def test_two_loads_keep_both_and_reading_the_report_sends_nothing(spark, tmpdir_shared):
    from tablesteps.operators.order import asc
    from tablesteps.sinks.rest import api_payloads, send_payloads

    url = "file://" + os.path.join(tmpdir_shared, "api")
    df = spark.range(0, 25).repartition(3)
    one = send_payloads(api_payloads(df, [asc("id")], 10), url, transport="file")
    send_payloads(api_payloads(df, [asc("id")], 10), url, transport="file")
    folder = os.path.join(tmpdir_shared, "api")
    assert len(os.listdir(folder)) == 6
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    assert one.count() == 3 and one.count() == 3 and os.listdir(folder) == []
    send_payloads(api_payloads(df, [asc("id")], 10), url, transport="file", run_id="again")
    send_payloads(api_payloads(df, [asc("id")], 10), url, transport="file", run_id="again")
    bodies = [json.load(open(os.path.join(folder, f))) for f in sorted(os.listdir(folder))]
    assert [[r["id"] for r in b] for b in bodies] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_null_sub_documents_stay_null(spark, tmpdir_shared):
    from tablesteps.sources.documents import read_documents

    p = put(tmpdir_shared, "n.jsonl", '{"i":1,"a":null,"l":[{"x":1},null]}\n{"i":2,"a":{"b":{"$date":"2024-01-02T03:04:05Z"}},"l":null}\n')
    got = {r.i: r for r in read_documents(spark, p).collect()}
    assert got[1].a is None and got[1].l[1] is None and got[1].l[0].x == 1
    assert got[2].a.b is not None and got[2].l is None


def test_a_load_that_fails_sends_only_the_rest_the_second_time(spark, tmpdir_shared, monkeypatch):
    from tablesteps.operators.order import asc
    from tablesteps.sinks.rest import acknowledged, send_remaining

    folder, ledger = os.path.join(tmpdir_shared, "restart"), os.path.join(tmpdir_shared, "ledger")
    payloads = api_payloads(spark.range(0, 1000), [asc("id")], 10).repartition(4, "batch_id")
    # A batch whose file cannot be made stands for a refusal.
    os.makedirs(os.path.join(folder, "load-batch-000000050.json"))
    with pytest.raises(RuntimeError, match="batch 50"):
        send_remaining(payloads, "file://" + folder, ledger, "load", transport="file")
    first = {f for f in os.listdir(folder) if os.path.isfile(os.path.join(folder, f)) and f.endswith(".json")}
    acked = {r.batch_id for r in acknowledged(spark, ledger).collect()}
    assert first == {f"load-batch-{b:09d}.json" for b in acked} and 50 not in acked and 50 <= len(acked) < 100
    os.rmdir(os.path.join(folder, "load-batch-000000050.json"))
    for f in first:
        os.remove(os.path.join(folder, f))
    report = send_remaining(payloads, "file://" + folder, ledger, "load", transport="file")
    assert sorted(r.batch_id for r in report.collect()) == list(range(100))
    again = {f for f in os.listdir(folder) if f.endswith(".json")}
    assert again == {f"load-batch-{b:09d}.json" for b in range(100) if b not in acked}
    assert send_remaining(payloads, "file://" + folder, ledger, "load", transport="file").count() == 100
    assert {f for f in os.listdir(folder) if f.endswith(".json")} == again
