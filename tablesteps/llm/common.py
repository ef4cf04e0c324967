"""Shared plumbing of the training-data operators.

``map_text`` runs one vectorised function over a text column inside
tasks: rows stream through in slices of bounded bytes and rows, so a
task's memory follows one slice (or one very long text), never a
partition.  Column names are positional in between, so extra columns of
any name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tablesteps.session import shared_dir, ship_package

#: A slice handed to a text function: bytes of text and rows at most
#: (one longer text forms a slice of its own).
SLICE_BYTES = 2 << 20
SLICE_ROWS = 512
#: Bytes of an Arrow batch between Spark and its Python workers, unless the session sets its own bound.
ARROW_BYTES = 8 << 20
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def quoted(name: str) -> str:
    """A column name with dots or back-ticks, safe for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 (of the id as text) leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut,
    and the rows survive the loss of any executor."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table once everything that reads it is written itself."""
    path = getattr(df, "saved_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def prepare_workers(spark: SparkSession) -> None:
    """Before Python runs in tasks: the package reaches the workers, and batches of texts stay small
    (Spark's default of 64 MB is held several times, outside the heap and in the worker)."""
    ship_package(spark)
    if spark.conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))


def slices(batch: pa.RecordBatch, text: int, max_bytes: int, max_rows: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch within both bounds."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def texts_of(array: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by ``gap``; and where each starts (with the end as last)."""
    data = np.frombuffer(gap.join(texts) + gap if texts else b"", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return data, starts


def map_text(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    max_bytes: int = SLICE_BYTES,
    max_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``keep`` columns plus the ``fields`` that a text function gives for each row.

    ``make`` is called once in each task and returns the function from a
    slice of texts to one Arrow array per field.
    """
    prepare_workers(df.sparkSession)
    source = df.select(
        F.col(quoted(text_col)).cast("string").alias("t"),
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)],
    )
    kept = source.schema.fields[1:]
    inner = StructType([*kept, *[StructField(f"f{i}", f.dataType, True) for i, f in enumerate(fields)]])
    names = [f"k{i}" for i in range(len(keep))] + [f"f{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 0, max_bytes, max_rows):
                made = work(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=names)

    return source.mapInArrow(run, inner).toDF(*keep, *[f.name for f in fields])


def blocks_of(df: DataFrame, columns: list[str], sizes: Column, block_bytes: int) -> Iterator[list[tuple]]:
    """Rows of a query set, a bounded block at a time (driver memory: one block and one row)."""
    block, held = [], 0
    for row in df.select(*columns, sizes.alias("__size")).toLocalIterator():
        if block and held + row[-1] > block_bytes:
            yield block
            block, held = [], 0
        block.append(tuple(row)[:-1])
        held += row[-1]
    if block:
        yield block
