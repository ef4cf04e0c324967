"""Groups of bounded size, whatever the keys.

Operators that compare the rows of a group with one another get their groups
from here: a key with more than ``tile_rows`` rows is cut into slices, and every
two slices (and each slice with itself) form a tile of their own.  No row and no
pair is left out, no task gathers more than two slices, and the tiles of a hot
key spread over the cluster.  ``over_tiles`` streams a sorted partition and
hands one tile at a time to a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare_workers, saved


def tiled(rows: DataFrame, keys: list[str], spread_by: str, tile_rows: int) -> DataFrame:
    """``rows`` with ``own`` (the row's slice) and the tile ``lo`` <= ``hi``; one row for each tile that the row is in."""
    large = (
        rows.groupBy(*keys)
        .count()
        .filter(F.col("count") > tile_rows)
        .select(*keys, F.ceil(F.col("count") / tile_rows).cast("int").alias("cut"))
    )
    large = saved(rows.sparkSession, large, "tiles-large")  # usually empty; Spark joins it by its measured size
    cut = F.coalesce(F.col("cut"), F.lit(1))
    dealt = (
        rows.join(large, keys, "left")
        .withColumn("own", F.pmod(F.xxhash64(spread_by), cut).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    )
    return dealt.select(
        *rows.columns, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )


def over_tiles(
    rows: DataFrame, keys: list[str], make: Callable[[pa.Table], pa.Table | None], schema: StructType | str
) -> DataFrame:
    """``make`` applied to the rows of each tile of ``tiled`` rows."""
    prepare_workers(rows.sparkSession)
    groups = [*keys, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, groups):
            made = make(tile)
            if made is not None:
                yield from made.to_batches()

    return rows.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of equal keys, from batches sorted by them; only the run at hand is held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cuts = changes(table, keys)
        if held and not same_key(held[-1], table, keys):
            yield pa.concat_tables(held)
            held = []
        start = 0
        for cut in cuts.tolist():
            yield pa.concat_tables([*held, table.slice(start, cut - start)])
            held, start = [], cut
        held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions whose key differs from that of the row before."""
    new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return np.flatnonzero(new) + 1


def same_key(before: pa.Table, after: pa.Table, keys: list[str]) -> bool:
    return all(before.column(k)[before.num_rows - 1].as_py() == after.column(k)[0].as_py() for k in keys)
