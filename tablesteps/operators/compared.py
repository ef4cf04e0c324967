"""The first row of a table that compares as wanted with a row of another, without pairs of rows.

``first_compared`` answers, for each row with equal keys, which target of
smallest place has ``x`` and ``y`` above (or below) the row's own.  Rows and
targets are sorted together by key and ``x``, in range partitions; a row's
candidates are then the targets before it.

1. Each partition sweeps its rows in order and keeps, of the targets of the key
   at hand, those that no earlier target beats in ``y``: sorted by ``y`` they are
   sorted by place too, so a row finds its target by bisection.
2. Only a partition's first key can have targets in partitions before it.  What
   a partition kept of its last key goes to the blocks of 1, 2, 4 ... partitions
   that hold it; a row asks the blocks that make up all partitions before its own.
3. Within a block every target counts, so a row's answer is the least place among
   those with a greater ``y``: a running minimum over one sort by ``y``.

So the work is that of sorting n rows and n log2(partitions) at most, whatever
share of them has one key and however many find nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.session import ship_package, written_copy

COMPARISONS = (">", ">=", "<", "<=")
#: Kinds that the sweep compares outside Spark.
SWEPT = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def first_compared(targets: DataFrame, rows: DataFrame, n_keys: int, compared: Sequence[str]) -> DataFrame:
    """``row`` and ``at``, the least ``at`` of a target that compares with it; rows without one are absent.

    ``targets`` has ``k0`` ..., ``v0`` (``v1``) and a distinct long ``at``; ``rows`` the same with a distinct long
    ``row``.  ``compared`` holds one or two comparisons, "target value" to "row value".  Nulls compare with nothing.
    """
    keys, values = [f"k{i}" for i in range(n_keys)], [f"v{i}" for i in range(len(compared))]
    none = F.lit(None).cast("long")
    both = targets.select(*keys, *values, F.col("at").cast("long").alias("at"), none.alias("row")).unionAll(
        rows.select(*keys, *values, none.alias("at"), F.col("row").cast("long").alias("row"))
    )
    for c in [*keys, *values]:
        both = both.filter(F.col(c).isNotNull())
    if len(compared) == 1:
        return _least_before(both, keys, "v0", compared[0])
    x, y = (("v0", compared[0]), ("v1", compared[1]))
    if not isinstance(both.schema["v1"].dataType, SWEPT):
        x, y = y, x
    if not isinstance(both.schema[y[0]].dataType, SWEPT):
        raise ValueError("one of two comparisons must be of numbers, dates or times")
    ship_package(both.sparkSession)
    kinds = {f.name: f.dataType for f in both.schema.fields}
    order = [*keys, *_in_order(*x)]
    laid = both.repartitionByRange(*order, "at", "row").sortWithinPartitions(*order, "at", "row")
    laid = laid.select(F.spark_partition_id().alias("part"), *keys, F.col(y[0]).alias("y"), "at", "row")
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), *[T.StructField(k, kinds[k]) for k in keys], T.StructField("y", kinds[y[0]]),
         T.StructField("at", T.LongType()), T.StructField("row", T.LongType()), T.StructField("ask", T.BooleanType())]
    )
    swept = written_copy(laid.mapInArrow(sweep(n_keys, y[1]), schema), "first-compared")
    local = swept.filter("row is not null and at is not null").select("row", "at")
    last = swept.agg(F.max("part")).first()[0] or 0  # one number
    levels = F.sequence(F.lit(0), F.lit(max(last.bit_length() - 1, 0)))
    level, part = F.col("level"), F.col("part")
    halved = F.floor(part / F.pow(F.lit(2), level)).cast("int")
    # The steps that a partition kept, in every block that holds the partition.
    steps = swept.filter("row is null").withColumn("level", F.explode(levels)).withColumn("block", halved)
    steps = steps.select(*keys, "level", "block", F.col("y").alias("v0"), "at", "row")
    up = y[1].startswith(">")
    blocks = steps.groupBy(*keys, "level", "block").agg((F.max if up else F.min)("v0").alias("far"), F.min("at").alias("best"))
    # The partitions before the n-th are one block for each bit of n.
    asks = swept.filter("row is not null and ask").withColumn("level", F.explode(levels))
    asks = asks.withColumn("block", halved - 1).filter(F.pmod("block", F.lit(2)) == 0)
    asks = asks.join(blocks, [*keys, "level", "block"])
    hopeful = (F.col("y") <= F.col("far")) if up else (F.col("y") >= F.col("far"))
    asks = asks.filter(hopeful & (F.col("at").isNull() | (F.col("best") < F.col("at"))))
    asks = asks.select(*keys, "level", "block", F.col("y").alias("v0"), none.alias("at"), "row")
    carried = _least_before(steps.unionAll(asks), [*keys, "level", "block"], "v0", y[1])
    return local.unionAll(carried).groupBy("row").agg(F.min("at").alias("at"))


def _in_order(value: str, compared: str) -> list[Column]:
    """The sort in which the targets that compare with a row are those before it."""
    by_value = F.col(value).desc() if compared.startswith(">") else F.col(value).asc()
    target = F.col("row").isNull()
    return [by_value, target.desc() if compared.endswith("=") else target.asc()]


def _least_before(both: DataFrame, keys: Sequence[str], value: str, compared: str) -> DataFrame:
    """``row`` and the least ``at`` before it among its keys, in the order of ``_in_order``: a running minimum in each
    range partition, and one number carried over for each key and partition."""
    order = _in_order(value, compared)
    laid = both.repartitionByRange(*keys, *order, "at", "row")
    laid = written_copy(laid.withColumn("part", F.spark_partition_id()), "least-before")
    upto = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = laid.withColumn("least", F.min("at").over(upto)).filter("row is not null")
    ends = laid.groupBy("part", *keys).agg(F.min("at").alias("end"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.min("end").over(before)).filter("carry is not null").drop("end")
    out = found.join(carried, ["part", *keys], "left").select("row", F.least("least", "carry").alias("at"))
    return out.filter("at is not null").groupBy("row").agg(F.min("at").alias("at"))


def ordered(column: pa.Array) -> list:
    """Values that Python compares as Spark does: floats as integers of the same order, NaN above all."""
    if pa.types.is_floating(column.type):
        numbers = column.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
        bits = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
        bits = np.where(np.isnan(numbers), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
        return bits.tolist()
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.int64()).to_pylist()
    if pa.types.is_date32(column.type):
        return column.cast(pa.int32()).to_pylist()
    return column.to_pylist()


def sweep(n_keys: int, compared: str):
    """Rows of a partition in order (part, keys, y, at of a target, row): the rows with the least ``at`` before them, and
    whether to ask the partitions before; at the end the targets kept of the last key, without a row."""
    sign = 1 if compared.startswith(">") else -1
    place = bisect_left if compared.endswith("=") else bisect_right

    def plain(v):
        return "NaN" if v != v else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ask, part, names, kinds = None, False, 0, None, None
        ys, ats, raw = [], [], []  # ascending by y (in the wanted direction), so also by at
        for batch in batches:
            if not batch.num_rows:
                continue
            names, kinds = [*batch.schema.names, "ask"], [*batch.schema.types, pa.bool_()]
            columns = [batch.column(1 + i).to_pylist() for i in range(n_keys)]
            y_column = batch.column(1 + n_keys)
            part = batch.column(0)[0].as_py()
            found, asking = [], []
            for j, (k, y, a) in enumerate(zip(zip(*columns), ordered(y_column), batch.column(2 + n_keys).to_pylist())):
                if k != key and (key is None or tuple(map(plain, k)) != tuple(map(plain, key))):
                    ask, key = key is None, k
                    ys, ats, raw = [], [], []
                y *= sign
                if a is None:
                    at = place(ys, y)
                    found.append(ats[at] if at < len(ats) else None)
                    asking.append(ask)
                    continue
                found.append(None)
                asking.append(False)
                end = bisect_left(ys, y)
                if end < len(ys) and ats[end] <= a:
                    continue  # an earlier target reaches as far
                begin = end
                while begin and ats[begin - 1] > a:
                    begin -= 1
                end += end < len(ys) and ys[end] == y
                ys[begin:end], ats[begin:end], raw[begin:end] = [y], [a], [y_column[j]]
            is_row = pc.is_valid(batch.column(3 + n_keys))
            arrays = [*batch.columns[: 2 + n_keys], pa.array(found, pa.int64()), batch.column(3 + n_keys), pa.array(asking, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(is_row)
        if ats:
            n = len(ats)
            arrays = [pa.array([part] * n, kinds[0]), *[pa.array([v] * n, t) for v, t in zip(key, kinds[1:])]]
            arrays += [pa.array([v.as_py() for v in raw], kinds[1 + n_keys]), pa.array(ats, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([False] * n)], names=names)

    return run
