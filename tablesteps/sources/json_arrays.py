"""One JSON array of any size, read in splits.

Spark's text reader cuts the file at ``}``, so a document on one line splits as
well as a pretty-printed one.  Where an element of the top-level array ends
depends on all text before it, but only through two numbers, which a prefix
scan over the splits gives (one row per split):

1. Each split counts its quotes (a backslash hides the next character) and, for
   both answers to "does the split begin inside a string", by how much the depth
   of brackets changes.
2. Running sums over the splits of a file give the answer and the depth at each
   split's start.
3. From there on each split cuts its text at the commas of depth one.  Elements
   that cross splits are put together from their pieces (``quoted_records``).

The elements become JSON Lines in the shared folder, which Spark reads and types
as usual.  Documents with comments need ``read_json``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.session import shared_dir, ship_package, written_copy
from tablesteps.sources.quoted_records import HEAD, INSIDE, TAIL, WHOLE, batch_of, stitched

_SIGN = re.compile(r"\\.?|[\"\[\]{},]", re.S)
_DEPTH = {"[": 1, "{": 1, "]": -1, "}": -1}


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """``part`` (text up to the next closing brace), ``file``, ``block``."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("value").alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S5 for documents that are one top-level array (any number of files): one row per element, typed over all of
    them unless ``schema`` is given.  Elements that are no objects give rows of nulls."""
    ship_package(spark)
    parts = parts_of(spark, path)
    splits = parts.mapInArrow(changes_in, "file string, block bigint, quotes bigint, outside bigint, inside bigint")
    splits = splits.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    begun = begun.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    begun = written_copy(begun.select("file", "block", "quoted", "depth"), "json-splits")
    # One row for each split; the parts keep their order.
    marked = parts.join(F.broadcast(begun), ["file", "block"], "left").select("part", "file", "block", "quoted", "depth")
    pieces = written_copy(marked.mapInArrow(elements_in, "file string, block bigint, kind int, first boolean, record string"), "json-pieces")
    text = F.translate(F.col("record"), "\r\n", "  ")  # raw line ends stand between tokens only
    lines = stitched(pieces, "").select(text.alias("value")).filter(F.trim("value") != "")
    folder = shared_dir(spark, "json-elements")
    lines.write.text(folder)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(folder)


def signs(text: str) -> Iterator[tuple[int, str]]:
    """Places of quotes, brackets and commas; what a backslash hides is left out."""
    for m in _SIGN.finditer(text):
        if m[0][0] != "\\":
            yield m.start(), m[0]


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, str]]:
    """Each part with its brace, and whether its split begins with it.  The part behind the last brace gets one too;
    nothing follows the array's end, so it is not seen."""
    split = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            new, split = split != row[1:3], row[1:3]
            part = row[0][1:] if new and row[2] == 0 and row[0].startswith("\ufeff") else row[0]
            yield row, new, part + "}"


def changes_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: its quotes, and the change of depth if it begins outside or inside a string."""
    held: list = []
    names = ["file", "block", "quotes", "outside", "inside"]

    def row() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, kinds)], names=names)

    for (_, file, block), new, text in runs_of(batches):
        if new:
            if held:
                yield row()
            held = [file, block, 0, 0, 0]
        for _, sign in signs(text):
            if sign == '"':
                held[2] += 1
            elif sign != ",":
                held[3 + held[2] % 2] += _DEPTH[sign]
    if held:
        yield row()


def elements_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of the array, and pieces of those that cross the ends of a split."""
    at = None
    made: list[tuple] = []
    text_held: list[str] = []
    quoted, depth, cut = False, 0, False

    def ended(kind_cut: int, kind_uncut: int) -> None:
        made.append((*at, kind_cut if cut else kind_uncut, False, "".join(text_held)))
        text_held.clear()

    for row, new, text in runs_of(batches):
        if new:
            if at is not None and depth > 0:
                ended(TAIL, INSIDE)
            text_held.clear()
            at, quoted, depth = row[1:3], row[3], row[4]
            cut = depth == 0  # an element that begins here, or one from the split before
        start = 0
        for place, sign in signs(text):
            if sign == '"':
                quoted = not quoted
            elif quoted:
                continue
            elif sign == ",":
                if depth == 1:
                    text_held.append(text[start:place])
                    ended(WHOLE, HEAD)
                    start, cut = place + 1, True
            else:
                depth += _DEPTH[sign]
                if depth == 1 and sign == "[":
                    start = place + 1  # the array itself
                elif depth == 0:
                    text_held.append(text[start:place])
                    ended(WHOLE, HEAD)
                    start, cut = place + 1, True
                    break  # nothing of the document follows
        if depth > 0:
            text_held.append(text[start:])
        if len(made) >= 4096:
            yield batch_of(made)
            made = []
    if at is not None and depth > 0:
        ended(TAIL, INSIDE)
    yield batch_of(made)
