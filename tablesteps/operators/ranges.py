"""Joins and selections by ranges, without pairs of rows that don't belong together.

* ``range_join``      points in intervals (``between`` of two tables)
* ``latest_before``   for each row, the last row of another table up to its time
* ``group_quantiles`` exact discrete quantiles per group
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesteps.functions.names import named
from tablesteps.session import written_copy

#: Bins of one pass over the values of a group.
BINS = 1024
#: Points, and intervals, in a tile of a bucket with more pairs than the square of this; pairs in a task of a range join.
TILE, TASK_PAIRS = 2048, 1 << 24
#: Intervals from this length on (also without an end) share one bucket.
UNBOUNDED, UNBOUNDED_LEVEL = 1e300, 5000


def as_number(column: Column, kind: str) -> Column:
    """A double that keeps the order of numbers, dates and times (seconds; a time without zone needs none)."""
    if kind == "timestamp":
        return F.unix_micros(column) / 1e6
    if kind == "timestamp_ntz":
        clock = F.hour(column) * 3600 + F.minute(column) * 60 + F.extract(F.lit("SECOND"), column).cast("double")
        return F.unix_date(column.cast("date")) * 86400.0 + clock
    return F.unix_date(column).cast("double") if kind == "date" else column.cast("double")


def range_join(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: Sequence[tuple[str, str]] = (), how: str = "inner"
) -> DataFrame:
    """Every point with every interval that holds it (both ends included), and with equal ``on`` columns (points',
    intervals').  Columns of the points, then of the intervals.  ``how`` is ``inner`` or ``left``.

    An interval of length up to ``2^k`` lies in at most two buckets of that width, so it gives one or two rows with
    ``k`` and the bucket; a point gives one row for each ``k`` that occurs (few: they are powers of two).  Bucket
    equality is an ordinary equi-join, and the bounds are tested on the columns as they are.  Nulls, and intervals that
    end before they begin, hold nothing.

    Rows are small and pairs many, so tasks are cut by pairs, not by bytes: the pairs of each bucket are counted
    first.  A bucket of more than ``TILE`` squared is cut into tiles of ``TILE`` points and ``TILE`` intervals, and
    the join gets a partition for every ``TASK_PAIRS`` pairs.  With fewer pairs in all, Spark deals them by measured sizes.
    """
    if how not in ("inner", "left"):
        raise ValueError("range_join is inner or left")
    kinds = [dict(points.dtypes)[point], dict(intervals.dtypes)[low], dict(intervals.dtypes)[high]]
    p = points.select(*[named(c).alias(f"p{i}") for i, c in enumerate(points.columns)])
    i = intervals.select(*[named(c).alias(f"i{k}") for k, c in enumerate(intervals.columns)])
    at_p, at_lo, at_hi = (f"p{points.columns.index(point)}", f"i{intervals.columns.index(low)}", f"i{intervals.columns.index(high)}")
    x, lo, hi = as_number(F.col(at_p), kinds[0]), as_number(F.col(at_lo), kinds[1]), as_number(F.col(at_hi), kinds[2])
    sound = i.filter(F.col(at_lo) <= F.col(at_hi))
    # 2^level is the width of the buckets; a little more than the logarithm keeps rounding out.
    span = F.greatest(hi - lo, F.abs(lo) * 1e-9, F.lit(1e-9))
    level = F.when(span < UNBOUNDED, F.ceil(F.log2(span) + 1e-6)).otherwise(UNBOUNDED_LEVEL)
    sound = sound.withColumn("level", level.cast("int"))
    levels = [r[0] for r in sound.select("level").distinct().collect()]  # at most one for each power of two
    bucket = lambda v: F.when(F.col("level") == UNBOUNDED_LEVEL, 0).otherwise(F.floor(v / F.pow(F.lit(2.0), F.col("level"))))
    # Rows are numbered in written copies: tiles are dealt by the number, and matched points come back to theirs.
    p = written_copy(p.withColumn("row", F.monotonically_increasing_id()), "range-points")
    sound = written_copy(sound.withColumn("nth", F.monotonically_increasing_id()), "range-intervals")
    held = sound.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(lo), bucket(hi)))))
    seen = p.filter(F.col(at_p).isNotNull())
    seen = seen.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("bucket", bucket(x))
    pairs_on = [(f"p{points.columns.index(a)}", f"i{intervals.columns.index(b)}") for a, b in on]
    found = _in_tiles(seen, held, pairs_on, (F.col(f"l.{at_p}") >= F.col(f"r.{at_lo}")) & (F.col(f"l.{at_p}") <= F.col(f"r.{at_hi}")))
    mine, theirs = [c for c in p.columns if c != "row"], i.columns
    if how == "inner":
        return found.select(*mine, *theirs).toDF(*points.columns, *intervals.columns)
    found = found.select("row", *theirs)
    return p.join(found, "row", "left").select(*mine, *theirs).toDF(*points.columns, *intervals.columns)


def _in_tiles(seen: DataFrame, held: DataFrame, on: Sequence[tuple[str, str]], within: Column) -> DataFrame:
    """Points ``seen`` (numbered ``row``) with intervals ``held`` (``nth``) of the same level, bucket and ``on`` columns, where ``within`` holds."""
    own = [f"c{n}" for n in range(len(on))]

    def same(left: str, right: str, names: Sequence[tuple[str, str]]) -> Column:
        cond = (F.col(f"{left}.level") == F.col(f"{right}.level")) & (F.col(f"{left}.bucket") == F.col(f"{right}.bucket"))
        for a, b in names:
            cond = cond & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))
        return cond

    of_seen, of_held = [(a, c) for (a, _), c in zip(on, own)], [(b, c) for (_, b), c in zip(on, own)]
    cells = held.groupBy("level", "bucket", *[F.col(b).alias(c) for b, c in of_held]).agg(F.count(F.lit(1)).alias("n_held"))
    met = seen.alias("l").join(cells.alias("c"), same("l", "c", of_seen)).select(*[F.col(f"c.{c}") for c in cells.columns])
    met = met.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n_seen"))
    met = written_copy(met.withColumn("pairs", F.col("n_held").cast("double") * F.col("n_seen")), "range-cells")
    # Two numbers: all pairs, and those of the largest cell.
    pairs, most = met.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.max("pairs"), F.lit(0.0))).first()
    if most > TILE * TILE:
        hot = met.filter(F.col("pairs") > TILE * TILE).withColumns(
            {"of_seen": F.ceil(F.col("n_seen") / TILE), "of_held": F.ceil(F.col("n_held") / TILE)}
        )
        seen = _tiled(seen, hot, same("l", "c", of_seen), "row", "seen", "held")
        held = _tiled(held, hot, same("l", "c", of_held), "nth", "held", "seen")
    cond = same("l", "r", on)
    if most > TILE * TILE:
        cond = cond & (F.col("l.tile_seen") == F.col("r.tile_seen")) & (F.col("l.tile_held") == F.col("r.tile_held"))
    if pairs > TASK_PAIRS:
        spark = seen.sparkSession
        parts = max(int(pairs // TASK_PAIRS) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tiles = ["level", "bucket", *(["tile_seen", "tile_held"] if most > TILE * TILE else [])]
        alike = [(a, b) for a, b in on if seen.schema[a].dataType == held.schema[b].dataType]
        seen = seen.repartition(parts, *tiles, *[a for a, _ in alike])
        held = held.repartition(parts, *tiles, *[b for _, b in alike]).hint("merge")
    return seen.alias("l").join(held.alias("r"), cond & within)


def _tiled(rows: DataFrame, hot: DataFrame, same: Column, number: str, mine: str, other: str) -> DataFrame:
    """Rows with ``tile_<mine>``, one of their cell's tiles by their number, once for each ``tile_<other>``; 0 and 0 in cells that are not hot."""
    out = rows.alias("l").join(hot.alias("c"), same, "left")
    tiles = lambda side: F.coalesce(F.col(f"c.of_{side}"), F.lit(1).cast("long"))
    return out.select(
        "l.*",
        F.pmod(F.xxhash64(f"l.{number}"), tiles(mine)).alias(f"tile_{mine}"),
        F.explode(F.sequence(F.lit(0).cast("long"), tiles(other) - 1)).alias(f"tile_{other}"),
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    tie: Sequence[str],
    take: Sequence[str],
) -> DataFrame:
    """Each row of ``left`` with the ``take`` columns of the last ``right`` row of equal ``on`` columns whose time is not
    after its own (null where there is none); of rows of one time the last by the ``tie`` columns.  Null keys and
    null times match nothing.

    Both tables are sorted together by key and time, in range partitions, into a written copy.  Each partition fills
    values forward by itself; what it cannot know, the last value of a key in the partitions before it, is carried over
    from one row per key and partition.  So a hot key is spread over as many partitions as it fills.
    """
    keys = [f"k{n}" for n in range(len(on))]
    own = [f"l{n}" for n in range(len(left.columns))]
    kinds = dict(right.dtypes)
    payload = F.struct(F.lit(True).alias("there"), *[named(c).alias(f"v{n}") for n, c in enumerate(take)])
    order = F.struct(F.lit(0).alias("o"), *[named(c).alias(f"t{n}") for n, c in enumerate(tie)])
    a = left.select(
        *[named(x).alias(k) for k, (x, _) in zip(keys, on)],
        named(left_time).alias("at"),
        F.lit(1).alias("side"),
        F.lit(None).cast(right.select(order.alias("t")).schema[0].dataType).alias("tie"),
        F.lit(None).cast(right.select(payload.alias("v")).schema[0].dataType).alias("value"),
        F.struct(*[named(c).alias(n) for n, c in zip(own, left.columns)]).alias("row"),
    )
    row_kind = a.schema["row"].dataType
    usable = F.col("at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    b = right.select(
        *[named(y).alias(k) for k, (_, y) in zip(keys, on)],
        named(right_time).cast(dict(left.dtypes)[left_time] if kinds[right_time] != dict(left.dtypes)[left_time] else kinds[right_time]).alias("at"),
        F.lit(0).alias("side"),
        order.alias("tie"),
        payload.alias("value"),
        F.lit(None).cast(row_kind).alias("row"),
    ).filter(usable)
    ranged = a.filter(usable).unionAll(b).repartitionByRange(*keys, "at", "side", "tie")
    laid = written_copy(ranged.withColumn("part", F.spark_partition_id()), "latest-before")
    within = Window.partitionBy("part", *keys).orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = laid.withColumn("found", F.last("value", ignorenulls=True).over(within)).filter(F.col("side") == 1)
    lasts = laid.groupBy("part", *keys).agg(
        F.max_by(F.when(F.col("side") == 0, F.col("value")), F.when(F.col("side") == 0, F.struct("at", "tie"))).alias("end")
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("carry", F.last("end", ignorenulls=True).over(before)).filter("carry is not null")
    out = filled.join(carried.select("part", *keys, "carry"), ["part", *keys], "left")
    value = F.coalesce("found", "carry")
    got = [value.getField(f"v{n}") for n in range(len(take))]
    matched = out.select(*[F.col("row").getField(n) for n in own], *got)
    nothing = [F.lit(None).cast(kinds[c]) for c in take]
    rest = a.filter(~F.coalesce(usable, F.lit(False))).select(*[F.col("row").getField(n) for n in own], *nothing)
    return matched.unionAll(rest).toDF(*left.columns, *take)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], bins: int = BINS) -> DataFrame:
    """Exact discrete quantiles: for each group and ``q`` the smallest value that at least a share ``q`` of the group's
    non-null values do not exceed (``quantile_disc``).  Columns: the keys, ``q``, ``value`` (as double), ``n``.

    Selection by refined histograms: a pass counts the values of the current range of each group in ``bins`` bins
    (partial aggregates, so a hot group sends one row per bin and task) and goes on in the bin that holds the rank.
    Ranges shrink by ``bins`` each pass and end at one value, after a few passes; no group is gathered or sorted.
    """
    if not quantiles or not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles are between 0 and 1")
    names = [f"g{n}" for n in range(len(keys))]
    data = df.select(*[named(k).alias(n) for k, n in zip(keys, names)], named(value).cast("double").alias("x")).filter("x is not null")
    hashed = F.xxhash64(*names) if names else F.lit(0)  # joins by a null-safe key need an equal column to hash
    data = data.withColumn("h", hashed)
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    state = data.groupBy("h", *names).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = state.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    state = written_copy(state.withColumn("rank", F.greatest(F.ceil(F.col("n") * F.col("q")), F.lit(1))), "quantiles")
    done = []
    while True:
        done.append(state.filter("lo = hi"))
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            break
        cond = F.col("d.h") == F.col("s.h")
        for c in same("d", "s"):
            cond = cond & c
        ranges = open_.select("h", *names, "lo", "hi").distinct()
        cond = cond & (F.col("d.x") >= F.col("s.lo")) & (F.col("d.x") <= F.col("s.hi"))
        inside = data.alias("d").join(ranges.alias("s"), cond).select("s.h", *[f"s.{n}" for n in names], "s.lo", "s.hi", "d.x")
        # Divided before the difference is taken, so that no range overflows; the order of values is kept.
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        binned = inside.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
        binned = binned.withColumn("bin", F.when(F.col("x") == F.col("hi"), bins).otherwise(F.col("bin")))
        counts = binned.groupBy("h", *names, "lo", "hi", "bin").agg(
            F.count(F.lit(1)).alias("m"), F.min("x").alias("least"), F.max("x").alias("most")
        )
        upto = Window.partitionBy("h", *names, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("m").over(upto))
        cond = (F.col("o.h") == F.col("c.h")) & (F.col("o.lo") == F.col("c.lo")) & (F.col("o.hi") == F.col("c.hi"))
        for c in same("o", "c"):
            cond = cond & c
        # rank counts from the range's own start.
        cond = cond & (F.col("o.rank") <= F.col("c.upto")) & (F.col("o.rank") > F.col("c.upto") - F.col("c.m"))
        state = written_copy(
            open_.alias("o").join(counts.alias("c"), cond).select(
                "o.h", *[f"o.{n}" for n in names], "o.n", F.col("c.least").alias("lo"), F.col("c.most").alias("hi"), "o.q",
                (F.col("o.rank") - (F.col("c.upto") - F.col("c.m"))).alias("rank"),
            ),
            "quantiles",
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*names, "q", "lo", "n").toDF(*keys, "q", "value", "n")
