"""REST/JSON pages as a Spark source.

Division of work:

* a small Python data source does the I/O only.  An unknown number of
  pages is found by a galloping search when the scan is planned (pages 1,
  2, 4, ... until an empty one, then by halves); the pages are then
  dealt as contiguous ranges of equal length, and no task asks past the
  end.  Each request is retried (linear back-off), a page that keeps
  failing raises (defect D16 not copied); tasks emit (page, item index,
  item JSON) and a mark for each page asked;
* Spark does the rest JVM-side: column names in first-seen order
  (``json_object_keys``), one type per column (``schema_of_variant_agg``:
  whole numbers -> long, other numbers -> double, nested values -> JSON
  text), and the values (``try_variant_get``).

Transports are pluggable: ``http`` (urllib) and ``file`` (a folder of
page bodies, used by the tests; no sockets).
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablesteps.session import written_copy
from tablesteps.session import local_path, ship_package

FORMAT = "tablesteps_rest"
# Reference defaults.
DEFAULT_RETRIES = 3
DEFAULT_RETRY_DELAY = 1.0
DEFAULT_PAGE_PARAM = "page"
DEFAULT_SIZE_PARAM = "pageSize"
ENVELOPE_KEYS = ("data", "results", "items")

PAGE_SCHEMA = "page long, item_index long, item string"
# Item indexes of rows that only say what was asked: a page held, a page found empty, a page probed by planning.
READ, EMPTY, PROBED = -1, -2, -3


def page_url(url: str, page: int | None, size: int | None, page_param: str, size_param: str) -> str:
    if page is None:
        return url
    sep = "&" if "?" in url else "?"
    return f"{url}{sep}{page_param}={page}&{size_param}={size}"


def envelope_items(body: str) -> list:
    """Root array, or the first array among data/results/items, else the object."""
    doc = json.loads(body) if body.strip() else []
    if isinstance(doc, list):
        return doc
    if isinstance(doc, dict):
        for k in ENVELOPE_KEYS:
            if isinstance(doc.get(k), list):
                return doc[k]
        return [doc]
    return []


class HttpError(RuntimeError):
    pass


def fetch_http(url: str, headers: dict, timeout: float = 30.0) -> tuple[int, str]:
    req = urllib.request.Request(url, headers=headers, method="GET")
    try:
        with urllib.request.urlopen(req, timeout=timeout) as resp:  # noqa: S310 - caller's URL
            return resp.status, resp.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def fetch_file(url: str, headers: dict, timeout: float = 30.0) -> tuple[int, str]:
    """``file://<dir>?page=N&...`` -> the text under ``<dir>/page=N``.

    No page parameter reads ``<dir>/body``.  A missing page is an empty
    page (``[]``); a ``status`` file next to the body sets the status.
    """
    parts = urllib.parse.urlsplit(url)
    base = local_path(f"file://{parts.netloc}{parts.path}")
    q = urllib.parse.parse_qs(parts.query)
    page = next((v[0] for k, v in q.items() if k.lower() == "page"), None)
    folder = os.path.join(base, f"page={page}") if page is not None else os.path.join(base, "body")
    status_file = os.path.join(folder, "status")
    if os.path.exists(status_file):
        with open(status_file) as fh:
            code = int(fh.read().strip())
        if code >= 300:
            return code, ""
    if not os.path.isdir(folder):
        return 200, "[]"
    chunks = []
    for name in sorted(os.listdir(folder)):
        if name.startswith((".", "_")) or name == "status":
            continue
        with open(os.path.join(folder, name), encoding="utf-8") as fh:
            text = fh.read().strip()
        if text:
            chunks.append(text)
    return 200, "\n".join(chunks) if chunks else "[]"


TRANSPORTS = {"http": fetch_http, "file": fetch_file}


def request_with_retry(fetch, url: str, headers: dict, retries: int, delay: float) -> str:
    last = None
    for attempt in range(1, retries + 1):
        try:
            status, body = fetch(url, headers)
            if 200 <= status < 300:
                return body
            last = HttpError(f"HTTP {status} for {url}")
        except (OSError, ValueError) as e:
            last = e
        if attempt < retries:
            time.sleep(delay * attempt)
    raise HttpError(f"request failed after {retries} attempts: {last}")


class PageRange(InputPartition):
    """Pages ``first`` to ``last``; ``probes`` are pages that planning has asked already."""

    def __init__(self, first: int | None, last: int | None, probes: tuple[int, ...] = ()):
        self.first, self.last, self.probes = first, last, probes


def last_page(is_empty) -> tuple[int, list[int]]:
    """The last page before the first empty one (0: none) and the pages asked for it, about 2 log2 of them.

    ``is_empty(page)`` asks for one page.  Pages are taken to be filled from
    the first one on, as they are when a client reads until an empty page.
    """
    asked: list[int] = []

    def empty(page: int) -> bool:
        asked.append(page)
        return is_empty(page)

    held, past = 0, 1
    while not empty(past):
        held, past = past, past * 2
    while past - held > 1:
        middle = (held + past) // 2
        if empty(middle):
            past = middle
        else:
            held = middle
    return held, asked


def page_ranges(last: int, count: int) -> list[tuple[int, int]]:
    """Pages 1 to ``last`` in ``count`` contiguous ranges at most, whose lengths differ by one page at most."""
    count = max(1, min(count, last))
    cuts = [last * i // count for i in range(count + 1)]
    return [(a + 1, b) for a, b in zip(cuts, cuts[1:]) if b > a]


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        # option keys arrive lower-cased
        self.o = o = {k.lower(): v for k, v in options.items()}
        self.retries = int(o.get("retries", DEFAULT_RETRIES))
        self.delay = float(o.get("retrydelay", DEFAULT_RETRY_DELAY))
        if self.retries <= 0 or self.delay < 0:
            raise ValueError("retries must be positive and delay non-negative")
        self.size = int(o["pagesize"]) if "pagesize" in o else None

    def items(self, page: int | None) -> list:
        o = self.o
        headers = json.loads(o.get("headers", "{}"))
        if o.get("token"):
            headers["Authorization"] = f"Bearer {o['token']}"
        names = o.get("pageparam", DEFAULT_PAGE_PARAM), o.get("sizeparam", DEFAULT_SIZE_PARAM)
        fetch = TRANSPORTS[o.get("transport", "http")]
        url = page_url(o["url"], page, self.size, *names)
        return envelope_items(request_with_retry(fetch, url, headers, self.retries, self.delay))

    def partitions(self):
        if self.size is None:
            return [PageRange(None, None)]
        if "pages" in self.o:
            last, asked = int(self.o["pages"]), []
        else:
            last, asked = last_page(lambda page: not self.items(page))
        ranges = page_ranges(last, int(self.o["stripes"]))
        return [PageRange(1, 0, tuple(asked)), *[PageRange(a, b) for a, b in ranges]]

    def read(self, part: PageRange):
        for page in part.probes:
            yield (page, PROBED, None)
        for page in [None] if part.first is None else range(part.first, part.last + 1):
            items = self.items(page)
            yield (page or 1, READ if items else EMPTY, None)
            for i, item in enumerate(items):
                yield (page or 1, i, json.dumps(item) if isinstance(item, dict) else json.dumps({}))


class RestDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return PAGE_SCHEMA

    def reader(self, schema):
        return RestReader(dict(self.options))


#: Columns of a table at most: bounds the names that reach the driver.
MAX_COLUMNS = 10_000


def read_pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """Raw items: (page, item_index, item JSON text), and rows of a negative index for what was asked.

    Pages are dealt over the session's parallelism unless ``stripes`` names
    the number of ranges; ``pages`` names a known number of pages, which
    saves the search for it.
    """
    ship_package(spark)
    options.setdefault("stripes", spark.sparkContext.defaultParallelism)
    spark.dataSource.register(RestDataSource)
    r = spark.read.format(FORMAT).option("url", url)
    for k, v in options.items():
        r = r.option(k, json.dumps(v) if isinstance(v, dict) else str(v))
    return r.load()


def held_items(raw: DataFrame) -> DataFrame:
    """The items of a written copy before its first empty page (a page that emptied after planning ends the table,
    as for a client that reads page by page)."""
    end = raw.agg(F.min(F.when(F.col("item_index") == EMPTY, F.col("page")))).first()[0]
    rows = raw.filter(F.col("item_index") >= 0)
    return rows if end is None else rows.filter(F.col("page") < end)


def page_requests(raw: DataFrame) -> DataFrame:
    """One row: ``pages_held``, ``pages_read`` (pages that tasks asked for), ``pages_probed`` (asked by
    planning), ``n_items``."""

    def number(index: int):
        return F.count(F.when(F.col("item_index") == index, 1))

    return raw.agg(
        number(READ).alias("pages_held"),
        (number(READ) + number(EMPTY)).alias("pages_read"),
        number(PROBED).alias("pages_probed"),
        F.count(F.when(F.col("item_index") >= 0, 1)).alias("n_items"),
    )


def _kind(schema_text: str) -> str:
    s = (schema_text or "").upper()
    if s.startswith(("BIGINT", "INT", "SMALLINT", "TINYINT")):
        return "bigint"
    if s.startswith("DECIMAL(") and s.endswith(",0)"):
        return "bigint"
    if s.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
        return "double"
    if s.startswith("BOOLEAN"):
        return "boolean"
    if s.startswith("STRING") or s.startswith("VOID") or not s:
        return "string"
    return "json"


def items_to_table(items: DataFrame) -> DataFrame:
    """Typed table from item JSON text (see module docstring).

    One aggregation finds every column with its first-seen position and
    the merged type of its values; its result has one row per column,
    ``MAX_COLUMNS`` at most.
    """
    fields = F.try_variant_get(F.parse_json("item"), "$", "map<string,variant>")
    keyed = items.select(
        "page", "item_index", F.posexplode(F.json_object_keys("item")).alias("kpos", "key"), fields.alias("fields")
    )
    meta = (
        keyed.groupBy("key")
        .agg(
            F.min(F.struct("page", "item_index", "kpos")).alias("first"),
            F.schema_of_variant_agg(F.element_at("fields", F.col("key"))).alias("kind"),
        )
        .orderBy("first")
        .select("key", "kind")
        .limit(MAX_COLUMNS + 1)
        .collect()
    )
    if len(meta) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns: are ids used as keys?")
    if not meta:
        return items.select().limit(0)
    v = F.parse_json("item")
    cols = []
    for name, kind_text in meta:
        path = "$['" + name.replace("'", "\\'") + "']"
        k = _kind(kind_text)
        if k == "json":
            raw = F.variant_get(v, path, "variant")
            cols.append(F.when(F.is_variant_null(raw) | raw.isNull(), None).otherwise(F.to_json(raw)).alias(name))
        else:
            cols.append(F.try_variant_get(v, path, k).alias(name))
    return items.select(*cols)


def read_rest(spark: SparkSession, url: str, **options) -> DataFrame:
    """GET (paged when ``pageSize`` is given) -> typed table.

    The fetched items are written to the shared folder once, so the API is
    called once even though the column discovery and the result are two jobs.
    """
    return items_to_table(held_items(written_copy(read_pages(spark, url, **options), "rest-items")))


def read_typed(spark: SparkSession, url: str, schema: T.StructType | str, **options) -> DataFrame:
    """S21 Api<T>: each whole body deserialised to one typed value."""
    raw = written_copy(read_pages(spark, url, **options), "rest-items")
    return held_items(raw).select(F.from_json("item", schema).alias("value")).select("value.*")
