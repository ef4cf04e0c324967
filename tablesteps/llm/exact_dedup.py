"""Exact dedup over an extendible-hash index on shared files (DataFrame operations only).

1. Every document gives one narrow entry: the 64-bit key of its text without
   white space, a SHA-256 tag, its length.  The entries are written once.
2. The directory: a histogram of key prefixes (``MAX_DEPTH`` bits, so at most
   2^MAX_DEPTH rows reach the driver) tells how full a bucket is.  An overfull
   bucket is split by its next bit, and the directory doubled where the bucket
   is as deep as the directory, until every bucket holds its rows at most or
   ``MAX_DEPTH`` is reached.  What is still overfull then (one key with very
   many copies) goes on in overflow pages.
3. The index: a table of entries bucketed by (bucket, page), one file for each
   owner in the shared folder, ordered by key inside.  A bucket is a range of
   keys.
4. Owner tasks read their own file and nothing else.  In a bucket of one page
   all entries of a key lie together: the task chains them and knows the row
   that stays and the size, without another shuffle.  Pages of an overfull
   bucket are chained one by one, and their chains (one row for each page and
   key) are merged.  Every row of the result comes out of these two passes.
5. Bytes are compared: normalised texts are reduced to the different byte
   strings of each key (copies fall together before they move, so a group
   of any size is one string per task).  Different strings of one key are
   different chains by their tag; a key and tag with two strings stops the job
   instead of merging them.

Defined results: null counts as empty; all texts without other characters
than white space are equal.  Rows that repeat an id are rows of a group like
others (each counts); all rows with the kept id are kept.  A null id stays
only where no other id is as long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesteps.session import shared_dir

from .common import forget, quoted, saved

#: Entries in a bucket or overflow page, or more: a directory of the deepest level holds twice the table's rows.
BUCKET_ROWS = 1 << 13
#: Bits of the deepest directory: bounds its rows, also on the driver.
MAX_DEPTH = 16
#: Owner tasks at most; an owner of more than one page has them in one file.
MAX_OWNERS = 1 << 15

# White space that does not count (fixed by the contract).
BLANKS = " \t\n\x0b\f\r"


def without_blanks(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def grown(counts: list[int], bucket_rows: int, max_depth: int) -> list[int]:
    """The directory of ``max_depth`` bits after all splits: the first prefix of each prefix's bucket.

    ``counts`` are the entries of each prefix.  The directory begins with one
    bucket and no bits.
    """
    before = [0]
    for n in counts:
        before.append(before[-1] + n)
    entries, bits = [0], 0  # entries[i]: the bucket that the first ``bits`` bits of a key name
    depths = [0]
    waiting = [(0, 0)]  # a bucket and the first of its prefixes
    while waiting:
        bucket, first = waiting.pop()
        span = 1 << (max_depth - depths[bucket])
        if depths[bucket] == max_depth or before[first + span] - before[first] <= bucket_rows:
            continue
        if depths[bucket] == bits:  # the directory doubles
            entries, bits = [b for b in entries for _ in range(2)], bits + 1
        depths[bucket] += 1
        depths.append(depths[bucket])
        half = span >> 1
        at, end = (first + half) >> (max_depth - bits), (first + span) >> (max_depth - bits)
        entries[at:end] = [len(depths) - 1] * (end - at)
        waiting += [(bucket, first), (len(depths) - 1, first + half)]
    width = 1 << (max_depth - bits)
    firsts = {}
    for i, b in enumerate(entries):
        firsts.setdefault(b, i * width)
    return [firsts[b] for b in entries for _ in range(width)]


def directory(spark, entries: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """``prefix`` (of ``max_depth`` bits), ``bucket``, ``pages``: one row for each prefix."""
    counts = [0] * (1 << max_depth)
    for prefix, n in entries.groupBy(prefix_of(max_depth).alias("p")).count().collect():
        counts[prefix] = n
    # Buckets grow with the table, so that an overfull one at the deepest level means skew, not size.
    bucket_rows = max(bucket_rows, -(-2 * sum(counts) // len(counts)))
    firsts = grown(counts, bucket_rows, max_depth)
    held: dict[int, int] = {}
    for prefix, first in enumerate(firsts):
        held[first] = held.get(first, 0) + counts[prefix]
    number = {first: i for i, first in enumerate(held)}
    return [(p, number[f], max(1, -(-held[f] // bucket_rows))) for p, f in enumerate(firsts)]


def index_table(spark, entries: DataFrame, buckets: list[tuple[int, int, int]], max_depth: int = MAX_DEPTH) -> DataFrame:
    """The entries as files of the shared folder, one for each owner, with ``bucket``, ``page`` and ``pages``."""
    owners = min(MAX_OWNERS, sum({b: pages for _, b, pages in buckets}.values()))
    dealt = (
        entries.withColumn("prefix", prefix_of(max_depth))
        # At most 2^MAX_DEPTH rows of three numbers.
        .join(F.broadcast(spark.createDataFrame(buckets, "prefix int, bucket int, pages int")), "prefix")
        .withColumn("page", F.pmod(F.xxhash64("id", "tag"), F.col("pages")).cast("int"))
        .select("bucket", "page", "pages", "key", "id", "tag", "chars")
        .repartition(owners, "bucket", "page")
    )
    name = f"exact_index_{uuid.uuid4().hex[:12]}"
    path = shared_dir(spark, "exact-index")
    dealt.write.bucketBy(owners, "bucket", "page").sortBy("key", "tag").option("path", path).saveAsTable(name)
    index = spark.table(name)
    index.schema  # resolved now: the name can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    return index


def prefix_of(max_depth: int = MAX_DEPTH) -> Column:
    return F.shiftrightunsigned("key", 64 - max_depth).cast("int")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the text without white space)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    bare = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("t")).withColumn("bare", without_blanks(F.col("t")))
    key = F.xxhash64("bare")
    entries = saved(
        spark,
        bare.select("id", key.alias("key"), F.sha2(F.col("bare").cast("binary"), 256).alias("tag"), F.length("t").alias("chars")),
        "exact-entries",
    )
    buckets = directory(spark, entries, bucket_rows, max_depth)
    index = index_table(spark, entries, buckets, max_depth)
    forget(entries)
    compare_bytes(bare.select(key.alias("key"), "bare"))
    found = owned_chains(index.filter("pages = 1"))
    if any(pages > 1 for _, _, pages in buckets):
        found = found.unionAll(paged_chains(index.filter("pages > 1")))
    return found.select("id", "keep_id", "size", F.col("id").eqNullSafe(F.col("keep_id")), "tag").toDF(
        id_col, "keep_id", "group_size", "kept", "text_sha256"
    )


def owned_chains(index: DataFrame) -> DataFrame:
    """``id``, ``keep_id``, ``size``, ``tag`` of buckets of one page: all inside their owner tasks."""
    chain = (
        Window.partitionBy("bucket", "page", "key", "tag")
        # The row that stays: most characters, then the smallest id (null last).
        .orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return index.select("id", F.first("id").over(chain).alias("keep_id"), F.count(F.lit(1)).over(chain).alias("size"), "tag")


def paged_chains(index: DataFrame) -> DataFrame:
    """The same of buckets with overflow pages: each page's chains in its owner task, merged over the pages."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))
    of_page = index.groupBy("bucket", "page", "key", "tag").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    whole = of_page.groupBy("bucket", "key", "tag").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    # Written, so that both sides of the join are dealt anew and Spark can split a key with very many rows.
    whole = saved(index.sparkSession, whole.select("bucket", "key", "tag", F.col("best.id").alias("keep_id"), "size"), "exact-chains")
    return index.join(whole, ["bucket", "key", "tag"]).select("id", "keep_id", "size", "tag")


def compare_bytes(texts: DataFrame) -> None:
    """Stop if two byte strings (columns ``key``, ``bare``) share key and tag."""
    strings = texts.distinct()  # copies fall together in each task, before they move
    chained = strings.groupBy("key", F.sha2(F.col("bare").cast("binary"), 256).alias("tag")).agg(F.count(F.lit(1)).alias("strings"))
    if not chained.filter("strings > 1").isEmpty():
        raise ValueError("different texts share key and tag")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay; all columns as they were."""
    kept = exact_groups(docs, id_col, text_col, **options).toDF("i", "keep", "size", "kept", "sha")
    stay = kept.filter("kept").select("i").distinct()
    inner = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])
    own = F.col(f"c{docs.columns.index(id_col)}")
    return inner.join(stay, own.eqNullSafe(F.col("i")), "left_semi").toDF(*docs.columns)
