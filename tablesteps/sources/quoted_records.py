"""Records of delimited text whose quoted cells hold newlines, read in splits.

Whether a line begins inside a quoted cell depends on all quotes before it in
its file.  Only their parity counts, so it comes from a prefix scan:

1. Each split counts the quotes of its lines (one row per split).
2. A running sum over the splits of a file gives the parity at each split's start.
3. Each split joins its lines to records from there on, in the order it reads
   them.  A record that crosses splits leaves a head, a tail, or whole splits in
   between; these pieces (two per split at most) are put together by a window
   over the pieces of a file.

A quote toggles the state wherever it stands, and a doubled quote twice, as in
the rule for quoted cells; a record left open at the end of its file ends
there.  Records end with ``\\n`` or ``\\r\\n``; inside quotes both stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesteps.session import ship_package, written_copy

#: Whole records, the end of one that began before the split, one that goes on behind it, a split inside one.
WHOLE, HEAD, TAIL, INSIDE = 0, 1, 2, 3


def lines_of(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """``line``, ``file``, ``block`` (start of the split), ``quotes`` in it."""
    text = F.col("value")
    count = F.when(text.contains(quote), F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))).otherwise(0)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        count.alias("quotes"),
    )


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame | None:
    """``file``, ``first`` (of its file), ``record`` in a written table; None where no line ends inside quotes."""
    lines = lines_of(spark, path, quote)
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("odd"))
    splits = written_copy(splits, "csv-splits")
    if not splits.filter("odd > 0").take(1):
        return None
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).filter("inside")
    # One row for each split at most; the lines keep their order.
    marked = lines.join(F.broadcast(opened.select("file", "block", "inside")), ["file", "block"], "left").select(
        "line", "file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), (F.col("quotes") % 2 == 1).alias("odd")
    )
    ship_package(spark)
    pieces = written_copy(
        marked.mapInArrow(records_in, "file string, block bigint, kind int, first boolean, record string"), "csv-records"
    )
    return stitched(pieces, "\n")


def stitched(pieces: DataFrame, between: str) -> DataFrame:
    """``file``, ``first``, ``record``: whole records, and those put together from the pieces of several splits."""
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", "record")
    # Of a split, the head or inside comes before the tail; every tail begins a record.
    order = [F.col("block"), F.col("kind") == TAIL]
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy(*order))
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn("number", number)
    held = F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("last"), "record")))
    joined = parts.groupBy("file", "number").agg(held.alias("held"), F.max("first").alias("first"))
    return whole.unionAll(joined.select("file", "first", F.array_join("held.record", between).alias("record")))


def records_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order joined to records, split by split."""
    split, held = None, []  # the split at hand, the lines of the open record
    inside = begun = first = False
    for batch in batches:
        made: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for line, file, block, opened, odd in zip(*columns):
            if split != (file, block):
                if held:
                    made.append((*split, INSIDE if begun else TAIL, first, "\n".join(held)))
                split, held, inside, begun, first = (file, block), [], opened, opened, block == 0
                if first and line.startswith("\ufeff"):
                    line = line[1:]
            held.append(line)
            inside ^= odd
            if not inside:
                record = held[0] if len(held) == 1 else "\n".join(held)
                made.append((*split, HEAD if begun else WHOLE, first, record.removesuffix("\r")))
                held, begun, first = [], False, False
        yield batch_of(made)
    if held:
        yield batch_of([(*split, INSIDE if begun else TAIL, first, "\n".join(held))])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    columns = list(zip(*rows)) or [()] * 5
    names = ["file", "block", "kind", "first", "record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
