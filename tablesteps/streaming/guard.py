"""Which steps may run on a stream, and how a stream is written.

The reference's async reader is a bounded pull; its nearest Spark form
is a file-drop stream (new files become micro-batches).  Row-local steps
(filter, select, add/remove/rename/fill columns, validation in skip or
log mode) run unchanged on a streaming DataFrame.  Order-dependent steps
(sort, skip/take, keep-first, batch ids) need the whole input and are
refused; sinks run per micro-batch through ``foreachBatch`` with a
checkpoint in the shared folder, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tablesteps.functions.names import named
from tablesteps.session import shared_dir

REFUSED_KINDS = ("Sort", "GroupBy", "Join", "Aggregate")


# Names of Spark's logical operators that keep state on a stream.
STATEFUL_NODES = {"Aggregate", "Distinct", "Deduplicate", "Join", "Window", "Sort", "GlobalLimit", "FlatMapGroupsInPandas"}


class NotStreamable(ValueError):
    pass


def check_streamable(pipeline) -> None:
    """Raise when a pipeline step cannot run on an unbounded input."""
    for i, s in enumerate(pipeline.steps, start=1):
        if s.kind in REFUSED_KINDS or getattr(s, "order_dependent", False):
            raise NotStreamable(f"step {i} ({s.kind}: {s.title}) needs the whole input; run it per batch instead")
    if pipeline.source.isStreaming:
        check_stateless(pipeline.plan_strict())


def check_stateless(df: DataFrame) -> None:
    """Raise when a streaming plan keeps state without a watermark (distinct, GROUP BY, joins in SQL text):
    its state would grow with the stream."""
    plan = df._jdf.queryExecution().analyzed()
    found = plan.toString()
    if "EventTimeWatermark" in found:
        return
    for line in found.splitlines():
        word = line.lstrip(" :+-~").split(" ")[0].split("(")[0]
        if word in STATEFUL_NODES:
            raise NotStreamable(f"{word} needs state for the whole stream; add a watermark or run it per batch")


def first_per_key_stream(df: DataFrame, keys: Sequence[str], time_col: str, within: str) -> DataFrame:
    """S3 with T9: the first row seen of each key, across micro-batches.

    A key is remembered for ``within`` (an interval such as ``"2 days"``) of
    event time after its first row, so state is bounded by the keys of
    that span; a repeat within it is dropped, in whatever file it comes.
    Rows of one micro-batch have no order: which of two repeats in one file
    stays is not defined.  Null is a key like others.  Rows more than
    ``within`` behind the newest event time seen by an earlier micro-batch are
    late and dropped, as Spark's watermark rule says.
    """
    if not df.isStreaming:
        raise ValueError("first_per_key_stream needs a streaming DataFrame; use remove_duplicates on a table")
    # Dates and times without a zone count as times of the session's zone; the column itself stays as it is.
    timed = df.withColumn("_first_at", named(time_col).cast("timestamp"))
    return timed.withWatermark("_first_at", within).dropDuplicatesWithinWatermark(list(keys)).drop("_first_at")


def run_stream(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    name: str = "stream",
    checkpoint: str | None = None,
    available_now: bool = True,
):
    """Start ``df`` into ``sink(batch_df, batch_id)``; returns the query."""
    if not df.isStreaming:
        raise ValueError("run_stream needs a streaming DataFrame")
    check_stateless(df)
    location = checkpoint or shared_dir(df.sparkSession, f"{name}-checkpoint")
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
