"""Round-trip queries for sources and sinks.

Each writes a driver table to a fresh folder under the session's shared
checkpoint folder, reads it back with the matching source and returns
it; the oracle is the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tablesteps.plans.catalogue import _HOT_KEY_SQL, _hot_orders, query, table
from tablesteps.session import local_path, shared_dir, written_copy
from tablesteps.sinks.files import write_csv, write_json_lines
from tablesteps.sinks.jdbc import write_jdbc
from tablesteps.sources.csv import read_csv
from tablesteps.sources.jdbc import read_jdbc
from tablesteps.sources.json import read_json_lines


def as_types_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """Cast columns back to the types of the original table."""
    types = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


@query("csv_roundtrip", "SELECT * FROM lineitem")
def csv_roundtrip(spark, d):
    src = table(spark, d, "lineitem")
    out = shared_dir(spark, "csv")
    write_csv(src, out, files=spark.sparkContext.defaultParallelism)
    back = read_csv(spark, out)  # header names + inference pass
    # Text has no narrower numbers and no zone: what must come back is a number, a time or text as it was.
    for f in src.schema.fields:
        kind = back.schema[f.name].dataType
        if _family(kind) != _family(f.dataType):
            raise AssertionError(f"{f.name}: {f.dataType} read back as {kind}")
    return as_types_of(back, src)


def as_uri(folder: str) -> str:
    """A folder as a URI: one that names its file system stays as it is."""
    return "file://" + folder if folder.startswith("/") else folder


def _family(kind) -> str:
    return "number" if isinstance(kind, NumericType) else "time" if "timestamp" in kind.typeName() else kind.typeName()


@query("csv_append", "SELECT * FROM orders")
def csv_append(spark, d):
    """Two halves appended to one folder; every part has its own header."""
    src = table(spark, d, "orders")
    out = shared_dir(spark, "csv-append")
    first = F.col("o_orderkey") % 2 == 0
    write_csv(src.filter(first), out, append=True)
    write_csv(src.filter(~first), out, append=True)
    return as_types_of(read_csv(spark, out), src)


@query("csv_quoted_newlines", "SELECT * FROM documents")
def csv_quoted_newlines(spark, d):
    """Whole texts with line breaks inside quotes, read by default: files are split, wherever a cell goes on."""
    src = table(spark, d, "documents")
    out = shared_dir(spark, "quoted")
    write_csv(src, out)
    schema = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return as_types_of(read_csv(spark, out, trim=False, schema=schema), src)


@query("csv_stream_newlines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_stream_newlines(spark, d):
    """Texts with line breaks inside quotes, dropped as files and picked up as a stream."""
    from tablesteps.sources.csv import read_csv_stream
    from tablesteps.streaming.guard import run_stream

    src = table(spark, d, "documents")
    inbox, sink = shared_dir(spark, "quoted-inbox"), shared_dir(spark, "quoted-out")
    write_csv(src, inbox)  # as many files as the table has parts
    stream = read_csv_stream(spark, inbox, src.schema)
    run_stream(stream, lambda batch, _: batch.write.mode("append").parquet(sink), "quoted").awaitTermination()
    return spark.read.schema(src.schema).parquet(sink)


@query("json_document", "SELECT * FROM part")
def json_document(spark, d):
    """Each file is one JSON array of as many rows as its part of the table holds, read in splits."""
    import pyarrow as pa

    from tablesteps.sources.json_arrays import read_json_array

    def as_array(batches):
        sign = "["
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                made.append(sign + text)
                sign = ","
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"], pa.string())], names=["value"])

    src = table(spark, d, "part")
    out = shared_dir(spark, "json-document")
    src.select(F.to_json(F.struct(*src.columns)).alias("value")).mapInArrow(as_array, "value string").write.text(out)
    return as_types_of(read_json_array(spark, out), src).select(*src.columns)


@query("json_path_past_end", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 2")
def json_path_past_end(spark, d):
    """An index that many rows do not have gives no value for them."""
    from tablesteps.functions.json_path import select_path

    o = table(spark, d, "orders")
    one = F.struct("o_orderkey", "o_custkey")
    arrays = F.array_repeat(one, F.pmod("o_orderkey", F.lit(3)).cast("int"))
    return select_path(o.select(arrays.alias("items")), "$.items[1]")


@query(
    "doc_nested_roundtrip",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS has_sub, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS day,
              CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice) AS BIGINT) END AS price FROM orders""",
)
def doc_nested_roundtrip(spark, d):
    """Dates and decimals inside sub-documents; a null sub-document stays null."""
    from tablesteps.sources.documents import read_documents, write_documents

    o = table(spark, d, "orders")
    sub = F.struct(
        F.col("o_orderdate").alias("day"), F.array(F.round("o_totalprice").cast("decimal(20,0)")).alias("prices")
    )
    src = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", sub).alias("sub"))
    out = shared_dir(spark, "documents-nested")
    write_documents(src, out)
    back = read_documents(spark, out)
    return back.select(
        "o_orderkey",
        F.col("sub").isNotNull().alias("has_sub"),
        F.col("sub.day").cast(o.schema["o_orderdate"].dataType).alias("day"),
        F.col("sub.prices")[0].cast("long").alias("price"),
    )


@query("json_roundtrip", "SELECT * FROM supplier")
def json_roundtrip(spark, d):
    src = table(spark, d, "supplier")
    out = shared_dir(spark, "json")
    write_json_lines(src, out)
    return as_types_of(read_json_lines(spark, out), src).select(*src.columns)


@query("jsonl_roundtrip", "SELECT * FROM orders")
def jsonl_roundtrip(spark, d):
    src = table(spark, d, "orders")
    out = shared_dir(spark, "jsonl")
    write_json_lines(src, out)
    back = read_json_lines(spark, out, schema=src.schema)
    return back


def _derby_url(spark, name: str) -> str:
    return f"jdbc:derby:{local_path(shared_dir(spark, name))};create=true"


@query("jdbc_roundtrip", "SELECT * FROM orders")
def jdbc_roundtrip(spark, d):
    src = table(spark, d, "orders")
    url = _derby_url(spark, "derby-orders")
    write_jdbc(src, url, "ORDERS_COPY", mode="overwrite", dialect="derby", batch_size=1000)
    back = read_jdbc(
        spark, url, table="ORDERS_COPY", partition_column='"o_orderkey"', num_partitions=4,
        properties={"preferTimestampNTZ": "true"},
    )
    return as_types_of(back, src)


@query("jdbc_partitioned", "SELECT * FROM customer")
def jdbc_partitioned(spark, d):
    src = table(spark, d, "customer")
    url = _derby_url(spark, "derby-customer")
    write_jdbc(src, url, "CUSTOMER_COPY", mode="overwrite", dialect="derby")
    back = read_jdbc(spark, url, table="CUSTOMER_COPY", partition_column='"c_custkey"', num_partitions=8)
    return as_types_of(back, src)


@query(
    "jdbc_balanced",
    f"SELECT o_orderkey, {_HOT_KEY_SQL} AS k, o_orderdate, o_totalprice FROM orders",
)
def jdbc_balanced(spark, d):
    """A third of all rows share one key; it is cut by the date and the order, the other keys by themselves."""
    from tablesteps.sources.jdbc_ranges import read_jdbc_balanced

    src = _hot_orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderdate", "o_totalprice")
    url = _derby_url(spark, "derby-balanced")
    write_jdbc(src, url, "HOT_ORDERS", mode="overwrite", dialect="derby")
    back = read_jdbc_balanced(
        spark, url, ['"k"', '"o_orderdate"', '"o_orderkey"'], table="HOT_ORDERS", num_partitions=16,
        properties={"preferTimestampNTZ": "true"},
    )
    return as_types_of(back, src)


# ---------------------------------------------------------------- REST
def write_pages(df: DataFrame, folder: str, page_size: int, order) -> None:
    """Lay a table out as API pages ``page=N`` (an envelope ``{"data": [...]}`` each)."""
    from tablesteps.operators.rows import batch_ids

    b = batch_ids(df, page_size, order, "page0")
    body = F.to_json(F.struct(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias("data")))
    pages = b.groupBy((F.col("page0") + 1).alias("page")).agg(body.alias("value"))
    pages.write.mode("overwrite").partitionBy("page").text(folder)


@query("rest_paged_read", "SELECT * FROM supplier")
def rest_paged_read(spark, d):
    from tablesteps.operators.order import asc
    from tablesteps.sources.rest import read_rest

    src = table(spark, d, "supplier")
    folder = shared_dir(spark, "rest-pages")
    write_pages(src, folder, 10, [asc("s_suppkey")])
    back = read_rest(spark, as_uri(folder), pageSize=10, stripes=4, transport="file", retryDelay=0)
    return as_types_of(back, src).select(*src.columns)


@query(
    "rest_page_requests",
    """WITH p AS (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, count(*) AS n_items FROM customer)
       SELECT pages AS pages_held, pages AS pages_read, CAST(2 * (floor(log2(pages)) + 1) AS BIGINT) AS pages_probed, n_items FROM p""",
)
def rest_page_requests(spark, d):
    """Pages asked for a table of unknown length: every page once, and about 2 log2 of their number to find the last."""
    from tablesteps.operators.order import asc
    from tablesteps.sources.rest import page_requests, read_pages

    folder = shared_dir(spark, "rest-requests")
    write_pages(table(spark, d, "customer"), folder, 50, [asc("c_custkey")])
    return page_requests(read_pages(spark, as_uri(folder), pageSize=50, transport="file", retryDelay=0))


@query(
    "api_payload_batches",
    """SELECT batch_id, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
       FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch_id FROM orders)
       GROUP BY batch_id""",
)
def api_payload_batches(spark, d):
    from tablesteps.operators.order import asc
    from tablesteps.sinks.rest import api_payloads

    p = api_payloads(table(spark, d, "orders"), [asc("o_orderkey")], 100)
    keys = F.from_json("payload", "array<struct<o_orderkey:bigint>>")
    return p.select(
        "batch_id",
        "n_rows",
        F.array_min(F.transform(keys, lambda x: x["o_orderkey"])).alias("first_key"),
        F.array_max(F.transform(keys, lambda x: x["o_orderkey"])).alias("last_key"),
    )


@query("rest_typed_read", "SELECT * FROM supplier")
def rest_typed_read(spark, d):
    from tablesteps.operators.order import asc
    from tablesteps.sources.rest import read_typed

    src = table(spark, d, "supplier")
    folder = shared_dir(spark, "rest-typed")
    write_pages(src, folder, 25, [asc("s_suppkey")])
    return read_typed(spark, as_uri(folder), src.schema, pageSize=25, stripes=3, transport="file", retryDelay=0)


# ---------------------------------------------------------------- documents
@query("doc_roundtrip", "SELECT * FROM orders")
def doc_roundtrip(spark, d):
    from tablesteps.sources.documents import read_documents, write_documents

    src = table(spark, d, "orders")
    out = shared_dir(spark, "documents")
    write_documents(src, out)  # extended JSON: o_orderdate -> {"$date": ...}
    return as_types_of(read_documents(spark, out), src).select(*src.columns)


# ---------------------------------------------------------------- streams
@query("stream_roundtrip", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def stream_roundtrip(spark, d):
    """Files dropped into a folder are picked up as a stream, filtered per
    micro-batch and appended to a table in the shared folder."""
    from tablesteps.sources.csv import read_csv_stream
    from tablesteps.streaming.guard import run_stream

    src = table(spark, d, "orders")
    inbox = shared_dir(spark, "inbox")
    write_csv(src, inbox)  # as many files as the table has parts
    sink = shared_dir(spark, "stream-out")
    stream = read_csv_stream(spark, inbox, src.schema).filter(F.col("o_orderstatus") != "P")

    def append(batch, _batch_id):
        batch.write.mode("append").parquet(sink)

    run_stream(stream, append, "orders-stream").awaitTermination()  # ends when the files on hand are read
    return spark.read.schema(src.schema).parquet(sink)


@query("stream_first_per_key", "SELECT DISTINCT o_custkey FROM orders")
def stream_first_per_key(spark, d):
    """Customers with orders, each once, from files that arrive in several micro-batches and repeat customers."""
    from tablesteps.sources.csv import read_csv_stream
    from tablesteps.streaming.guard import first_per_key_stream, run_stream

    src = table(spark, d, "orders")
    inbox = shared_dir(spark, "repeats-inbox")
    # As many files as the cluster has cores, two micro-batches of them.
    files = max(2, spark.sparkContext.defaultParallelism)
    write_csv(src.repartition(files), inbox)
    sink = shared_dir(spark, "repeats-out")
    stream = read_csv_stream(spark, inbox, src.schema, files_per_batch=-(-files // 2))
    # The tables' orders span seven years: no row is late.
    firsts = first_per_key_stream(stream, ["o_custkey"], "o_orderdate", "4000 days").select("o_custkey")
    run_stream(firsts, lambda batch, _: batch.write.mode("append").parquet(sink), "repeats").awaitTermination()
    return spark.read.schema(firsts.schema).parquet(sink)


@query(
    "api_send_restart",
    """SELECT batch_id, count(*) AS n_rows, CAST(200 AS INTEGER) AS status
       FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch_id FROM orders) GROUP BY batch_id""",
)
def api_send_restart(spark, d):
    """A load whose ledger holds every third batch as acknowledged sends the rest; the report is whole."""
    from tablesteps.operators.order import asc
    from tablesteps.sinks.rest import api_payloads, send_remaining

    payloads = written_copy(api_payloads(table(spark, d, "orders"), [asc("o_orderkey")], 500), "payloads")
    ledger = shared_dir(spark, "ledger")
    acked = payloads.filter("batch_id % 3 = 0").select(
        "batch_id", "n_rows", F.lit(200).alias("status"), F.sha2("payload", 256).alias("digest")
    )
    acked.write.parquet(ledger)
    return send_remaining(payloads, as_uri(shared_dir(spark, "sent")), ledger, "orders-load", transport="file")


@query("csv_detect_read", "SELECT * FROM supplier")
def csv_detect_read(spark, d):
    """S4 + S29: a ';'-separated export in a ``.csv`` folder, read through
    ``read_any`` with the delimiter detected from its first lines."""
    from tablesteps.sources.files import read_any

    src = table(spark, d, "supplier")
    out = shared_dir(spark, "detect").rstrip("/") + "/supplier.csv"
    write_csv(src, out, delimiter=";")
    return as_types_of(read_any(spark, out, delimiter=None), src).select(*src.columns)
