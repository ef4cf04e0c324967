"""REST sink (W16): JSON arrays of ``batch_size`` rows per request.

Batches are numbered from a dense row index in the given order; each
batch becomes one payload row (its size is bounded by the batch size),
and ``send_payloads`` posts them from the executors.  Delivery is
at-least-once (a retried task re-sends), so every request carries an
idempotency key derived from the load and the batch id.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.functions.names import named
from tablesteps.operators.order import OrderSpec, with_row_index
from tablesteps.session import local_path, ship_package, written_copy

# Fixed value: reference default batch size.
DEFAULT_BATCH_SIZE = 100


def api_payloads(df: DataFrame, order: OrderSpec, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """(batch_id, n_rows, payload): batch 1 sends single objects, else arrays."""
    if batch_size <= 0:
        raise ValueError("Batch size must be greater than zero")
    at, batch = "_api_at", "_api_batch"
    b = with_row_index(df, order, at).withColumn(batch, F.floor(F.col(at) / F.lit(batch_size)).cast("long"))
    rows = F.struct(F.col(at), F.struct(*[named(c) for c in df.columns]).alias("row"))
    in_order = F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["row"])
    payload = F.to_json(in_order) if batch_size > 1 else F.to_json(F.element_at(in_order, 1))
    out = b.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), payload.alias("payload"))
    return out.withColumnRenamed(batch, "batch_id")


def _post_file(url: str, body: str, key: str) -> int:
    parts = urllib.parse.urlsplit(url)
    folder = local_path(f"file://{parts.netloc}{parts.path}")
    os.makedirs(folder, exist_ok=True)
    final = os.path.join(folder, f"{key}.json")
    tmp = final + ".tmp"
    with open(tmp, "w", encoding="utf-8") as fh:
        fh.write(body)
    os.replace(tmp, final)  # same key -> same file: re-sends replace
    return 200


def _post_http(url: str, body: str, key: str, method: str, headers: dict) -> int:
    import urllib.request

    req = urllib.request.Request(url, data=body.encode(), method=method, headers={**headers, "Idempotency-Key": key, "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(req, timeout=30) as resp:  # noqa: S310 - caller's URL
            return resp.status
    except urllib.error.HTTPError as e:
        return e.code


def send_payloads(
    payloads: DataFrame,
    url: str,
    transport: str = "http",
    method: str = "POST",
    headers: dict | None = None,
    token: str | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Send each payload now; returns the report (batch_id, n_rows, status).  Non-2xx raises.

    The sends run once per call (the report is written to the shared
    folder, reading it sends nothing).  ``run_id`` names the load: retries of
    a task repeat its keys, another load has others.
    """
    hdrs = dict(headers or {})
    if token:
        hdrs["Authorization"] = f"Bearer {token}"
    load = run_id or uuid.uuid4().hex

    def send(batches):
        import pandas as pd

        for pdf in batches:
            statuses = []
            for bid, body in zip(pdf["batch_id"], pdf["payload"]):
                key = f"{load}-batch-{int(bid):09d}"
                if transport == "file":
                    status = _post_file(url, body, key)
                else:
                    status = _post_http(url, body, key, method, hdrs)
                if not 200 <= status < 300:
                    raise RuntimeError(f"HTTP {status} for batch {bid}")
                statuses.append(status)
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "n_rows": pdf["n_rows"], "status": statuses})

    ship_package(payloads.sparkSession)
    return written_copy(payloads.mapInPandas(send, "batch_id long, n_rows long, status int"), "rest-report")


LEDGER_SCHEMA = "batch_id long, n_rows long, status int, digest string"


def acknowledged(spark: SparkSession, ledger: str) -> DataFrame:
    """Batches that any attempt of a load had acknowledged (batch_id, n_rows, status, digest), each once."""
    rows = spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(ledger)
    return rows.filter("status >= 200 AND status < 300").dropDuplicates(["batch_id", "digest"])


def send_remaining(
    payloads: DataFrame,
    url: str,
    ledger: str,
    run_id: str,
    transport: str = "http",
    method: str = "POST",
    headers: dict | None = None,
    token: str | None = None,
) -> DataFrame:
    """Send the batches of a load that its ``ledger`` (a folder all executors share) does not hold as acknowledged.

    Returns the report of the whole load (batch_id, n_rows, status).  A
    batch that is refused ends its task's sending, but not the job: what was
    acknowledged by then is written to the ledger, and only then the call
    raises.  Called again with the same ledger and ``run_id``, it sends the
    rest.  A batch counts as acknowledged while its payload is the same; a
    changed one is sent again under its key.  Sends of a task that is lost with its
    executor repeat their keys.
    """
    spark = payloads.sparkSession
    hdrs = dict(headers or {})
    if token:
        hdrs["Authorization"] = f"Bearer {token}"

    def send(batches):
        import pandas as pd

        refused = False
        for pdf in batches:
            statuses = []
            for bid, body in zip(pdf["batch_id"], pdf["payload"]):
                status = None
                if not refused:
                    key = f"{run_id}-batch-{int(bid):09d}"
                    try:
                        status = _post_file(url, body, key) if transport == "file" else _post_http(url, body, key, method, hdrs)
                    except OSError:  # no answer at all
                        status = 0
                    refused = not 200 <= status < 300
                statuses.append(status)
            yield pd.DataFrame(
                {"batch_id": pdf["batch_id"], "n_rows": pdf["n_rows"], "status": pd.array(statuses, "Int32"), "digest": pdf["digest"]}
            )

    ship_package(spark)
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger)  # so that a first attempt finds a table
    keyed = payloads.select("batch_id", "n_rows", "payload", F.sha2("payload", 256).alias("digest"))
    left = keyed.join(acknowledged(spark, ledger).select("batch_id", "digest"), ["batch_id", "digest"], "left_anti")
    attempt = f"{ledger.rstrip('/')}/attempt-{uuid.uuid4().hex[:12]}"
    left.mapInPandas(send, LEDGER_SCHEMA).write.parquet(attempt)
    tried = spark.read.schema(LEDGER_SCHEMA).parquet(attempt)
    open_ = tried.filter("status IS NULL OR status < 200 OR status >= 300")
    n, bad, first = open_.agg(F.count(F.lit(1)), F.count("status"), F.min(F.when(F.col("status").isNotNull(), F.struct("batch_id", "status")))).first()
    if n:
        raise RuntimeError(f"{n} batches are not acknowledged, {bad} of them refused (first: batch {first[0]}, HTTP {first[1]})")
    whole = keyed.select("batch_id", "digest").join(acknowledged(spark, ledger), ["batch_id", "digest"])
    return written_copy(whole.select("batch_id", "n_rows", "status"), "rest-report")


__all__ = ["acknowledged", "api_payloads", "send_payloads", "send_remaining"]
