"""Pipelines of named steps with a step log and a run report (A1-A10).

A ``Pipeline`` is an immutable list of steps over a source.  Its plan is
recomputed from the list, so removing a step really removes its effect
(defect D20 not copied).  Row counts per step come from ``observe`` on
the same job that produces the result: no extra passes over the data.

Step kinds follow the reference's step types: Import, Export, Filter,
Sort, GroupBy, Join, Select, Aggregate and Code (SQL text or a Python
function of the DataFrame).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.operators import grouping as G
from tablesteps.operators import rows as R
from tablesteps.operators.join import join_step
from tablesteps.operators.order import Key, OrderSpec, chain, sort_columns
from tablesteps.operators.validate import Validator, validate

STEP_KINDS = ("Import", "Export", "Filter", "Sort", "GroupBy", "Join", "Select", "Aggregate", "Code")
# Texts and limit of the step log.
EMPTY_DESCRIPTION = "Empty transformation"
DESCRIPTION_LIMIT = 80

STEP_LOG_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("millis", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def describe(code: str | None) -> str:
    """First comment line (``--`` or ``//``), else the first line cut to 80 chars."""
    if not code or not code.strip():
        return EMPTY_DESCRIPTION
    lines = [ln.strip() for ln in code.split("\n") if ln.strip()]
    for ln in lines:
        if ln.startswith("--") or ln.startswith("//"):
            return ln.lstrip("-/ ").strip()
    first = lines[0]
    return first if len(first) <= DESCRIPTION_LIMIT else first[: DESCRIPTION_LIMIT - 3] + "..."


@dataclass(frozen=True)
class Step:
    kind: str
    title: str
    fn: Callable[[DataFrame], DataFrame]
    code: str | None = None
    order_dependent: bool = False

    def __post_init__(self):
        if self.kind not in STEP_KINDS:
            raise ValueError(f"step kind must be one of {STEP_KINDS}")


def run_sql_step(df: DataFrame, sql: str, name: str = "data") -> DataFrame:
    """A9 scripted step: SQL text that names the current table as ``{data}``."""
    spark = df.sparkSession
    return spark.sql(sql, **{name: df})


def check_step(df: DataFrame, step: Step) -> str | None:
    """A10: analyse a step without running it; the error text or None."""
    try:
        step.fn(df).schema
        return None
    except Exception as e:  # noqa: BLE001 - whatever the step's code raises is its error
        return _first_line(e)


def _first_line(e: Exception) -> str:
    return f"{e}".split("\n")[0] or type(e).__name__


@dataclass(frozen=True)
class Pipeline:
    """Steps over a source.  ``order`` is the current stable order-key
    chain: ``order_by`` puts its key in front and keeps the earlier keys
    as tie-breaks; take, skip, keep-first and batch follow it.  Start it
    with the source's arrival order (e.g. ARRIVAL_COLUMNS or a key)."""

    source: DataFrame
    steps: tuple[Step, ...] = ()
    source_name: str = "source"
    order: tuple[Key, ...] = ()

    # -- building ----------------------------------------------------------
    def add(self, step: Step) -> "Pipeline":
        return replace(self, steps=self.steps + (step,))

    def remove(self, index: int) -> "Pipeline":
        return replace(self, steps=self.steps[:index] + self.steps[index + 1 :])

    def filter(self, predicate: str | Column, title: str = "Filter") -> "Pipeline":
        code = predicate if isinstance(predicate, str) else None
        return self.add(Step("Filter", title, lambda df: R.filter_rows(df, predicate), code))

    def sort(self, order: OrderSpec, title: str = "Sort") -> "Pipeline":
        """Sort by ``order`` (dominant first); it becomes the pipeline's order."""
        new = tuple(chain(self.order, order))
        return replace(self.add(Step("Sort", title, lambda df: df.orderBy(*sort_columns(new)))), order=new)

    def order_by(self, column: str, title: str | None = None) -> "Pipeline":
        """T7 OrderBy: stable ascending, nulls first."""
        return self.sort([Key(column, True)], title or f"Order by {column}")

    def order_by_desc(self, column: str, title: str | None = None) -> "Pipeline":
        """T8 OrderByDescending: stable descending, nulls last."""
        return self.sort([Key(column, False)], title or f"Order by {column} descending")

    def _order(self) -> list[Key]:
        if not self.order:
            raise ValueError("this step depends on row order: start the pipeline with order=... or sort first")
        return list(self.order)

    def take(self, n: int, title: str | None = None) -> "Pipeline":
        """T4 Take(n) in the current order."""
        keys = self._order()
        return self.add(Step("Filter", title or f"Take {n}", lambda df: R.take(df, n, keys), order_dependent=True))

    def skip(self, n: int, title: str | None = None) -> "Pipeline":
        """T5 Skip(n) in the current order."""
        keys = self._order()
        return self.add(Step("Filter", title or f"Skip {n}", lambda df: R.skip(df, n, keys), order_dependent=True))

    def distinct(self, title: str = "Distinct") -> "Pipeline":
        return self.add(Step("Filter", title, R.distinct_rows))

    def remove_duplicates(self, key: str, title: str | None = None) -> "Pipeline":
        """First row per key in the current order."""
        keys = self._order()
        return self.add(Step("Filter", title or f"Remove duplicates by {key}", lambda df: R.remove_duplicates(df, key, keys), order_dependent=True))

    def fill_missing(self, column: str, value, title: str | None = None) -> "Pipeline":
        return self.add(Step("Select", title or f"Fill {column}", lambda df: R.fill_missing(df, column, value)))

    def remove_column(self, column: str, title: str | None = None) -> "Pipeline":
        return self.add(Step("Select", title or f"Remove {column}", lambda df: R.remove_column(df, column)))

    def rename_column(self, old: str, new: str, title: str | None = None) -> "Pipeline":
        return self.add(Step("Select", title or f"Rename {old} to {new}", lambda df: R.rename_column(df, old, new)))

    def batch(self, size: int, title: str | None = None) -> "Pipeline":
        """Rows unchanged plus their batch number in the current order."""
        keys = self._order()
        return self.add(Step("Select", title or f"Batch {size}", lambda df: R.batch_ids(df, size, keys), order_dependent=True))

    def validate(self, validator: Validator, mode: str = "skip", title: str = "Validate") -> "Pipeline":
        return self.add(Step("Filter", title, lambda df: validate(df, validator, mode)))

    def select(self, *cols: str | Column, title: str = "Select", **named) -> "Pipeline":
        return self.add(Step("Select", title, lambda df: R.project(df, *cols, **named)))

    def add_column(self, name: str, expr: str | Column, title: str | None = None) -> "Pipeline":
        return self.add(Step("Select", title or f"Add column {name}", lambda df: R.add_column(df, name, expr)))

    def group_by(self, key: str | list[str], title: str = "GroupBy", **aggs: Column) -> "Pipeline":
        return self.add(Step("GroupBy", title, lambda df: G.aggregate(df, key, **aggs)))

    def aggregate(self, title: str = "Aggregate", **aggs: Column) -> "Pipeline":
        return self.add(Step("Aggregate", title, lambda df: df.agg(*[e.alias(n) for n, e in aggs.items()])))

    def join(self, other: DataFrame, on, how: str = "inner", title: str = "Join") -> "Pipeline":
        return self.add(Step("Join", title, lambda df: join_step(df, other, on, how)))

    def code(self, sql_or_fn: str | Callable[[DataFrame], DataFrame], title: str = "Code") -> "Pipeline":
        if isinstance(sql_or_fn, str):
            return self.add(Step("Code", title, lambda df: run_sql_step(df, sql_or_fn), sql_or_fn))
        return self.add(Step("Code", title, sql_or_fn))

    # -- planning ----------------------------------------------------------
    def plan(self) -> DataFrame:
        """The result plan; a step that fails analysis leaves the data as it was."""
        return self.plan_checked()[0]

    def plan_strict(self) -> DataFrame:
        """The result plan; any failing step raises."""
        df = self.source
        for s in self.steps:
            df = s.fn(df)
        return df

    def plan_checked(self) -> tuple[DataFrame, list[str | None]]:
        """Fold the steps; a step that fails is skipped and its error kept
        (the data stays as it was before that step)."""
        df, _, errors, _ = self._fold(None)
        return df, errors

    def observed(self) -> tuple[DataFrame, list[Observation], list[str | None]]:
        """Plan with one row-count observation per step (and the source)."""
        df, obs, errors, _ = self._fold(self.source_name)
        return df, obs, errors

    def _fold(self, observe: str | None):
        """(plan, observations, step errors, milliseconds each step took to build, with the jobs it ran)."""

        def counted(df: DataFrame, i: int):
            if observe is None:
                return df, None
            o = Observation(f"{observe}-{i}")
            return df.observe(o, F.count(F.lit(1)).alias("rows")), o

        df, first = counted(self.source, 0)
        obs, errors, millis = [first], [], []
        for i, s in enumerate(self.steps, start=1):
            began = time.time()
            try:
                nxt = s.fn(df)
                nxt.schema
                df, o = counted(nxt, i)
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - whatever a step's code raises is logged, the data stays
                errors.append(_first_line(e))
                o = None
            obs.append(o)
            millis.append(int((time.time() - began) * 1000))
        return df, obs, errors, millis

    def run(self, sink: Callable[[DataFrame], object] | None = None, counts: bool = True) -> "RunReport":
        """A2: run the pipeline into ``sink`` (default: the no-op sink).

        ``counts`` observes the row count of the source and of every step
        in the same job.  Counting the source means reading all of its
        rows, so the first filter is then not pushed into the scan;
        ``counts=False`` runs the plain plan (full pushdown) and the step
        log has no row counts.  A failed run is a report with the step
        errors and times known until then, and the rows that finished tasks
        had counted where the job began (none where it did not).
        """
        start = time.time()
        report = RunReport(False, [], [], list(self.steps), 0.0)
        report.extra["source"] = self.source_name
        obs: list = []
        try:
            df, obs, report.step_errors, report.millis = self._fold(self.source_name if counts else None)
            if sink is None:
                df.write.format("noop").mode("overwrite").save()
            else:
                sink(df)
            report.success = True
            report.extra["exported"] = sink is not None
        except Exception as e:  # noqa: BLE001 - a failed run is a report, as in the reference
            report.error = _first_line(e)
        # All observations of a failed run belong to one job: the first tells whether it reported.
        known = report.success or any(o is not None for o in obs) and _reported(obs[0])
        report.counts = [_rows_seen(o, report.success) if known else None for o in obs]
        report.seconds = time.time() - start
        return report


def _rows_seen(o: Observation | None, finished: bool) -> int | None:
    """The rows an observation counted; of a failed run only if its job has reported (``get`` would wait for ever)."""
    if o is None or not finished and not _reported(o, 0.0):
        return None
    rows = o.get.get("rows")
    return int(rows or 0) if finished or rows is not None else None


def _reported(o: Observation, seconds: float = 2.0) -> bool:
    """Whether the counts of a failed job came in; Spark's listeners bring them shortly after the error."""
    made = getattr(o, "_jo", None)
    until = time.time() + seconds
    while made is not None and not made.future().isCompleted():
        if time.time() > until:
            return False
        time.sleep(0.02)
    return made is not None


@dataclass
class RunReport:
    success: bool
    counts: list[int | None]
    step_errors: list[str | None]
    steps: list[Step]
    seconds: float
    error: str | None = None
    extra: dict = field(default_factory=dict)
    millis: list[int] = field(default_factory=list)

    @property
    def failed(self) -> int:
        """Steps whose error was logged, and the run itself if it failed."""
        return sum(e is not None for e in self.step_errors) + (not self.success)

    @property
    def processed(self) -> int:
        real = [c for c in self.counts if c is not None]
        return real[-1] if real else 0

    def step_log(self, spark: SparkSession) -> DataFrame:
        """Import row, one row per step, export row when a sink was
        given (the step list is small: built on the driver)."""
        name = self.extra.get("source", "source")
        first = self.counts[0] if self.counts else None
        rows = [(0, f"Import: {name}", "Import", f"Loaded {first} rows from {name}" if first is not None else None, None, None, first, None, None)]
        prev = first
        for i, s in enumerate(self.steps, start=1):
            out = self.counts[i] if i < len(self.counts) else None
            err = self.step_errors[i - 1] if i - 1 < len(self.step_errors) else None
            rows.append((i, s.title, s.kind, describe(s.code) if s.code else s.title, s.code, prev, out, self.millis[i - 1] if i - 1 < len(self.millis) else None, err))
            if out is not None:
                prev = out
        if self.extra.get("exported"):
            n = len(self.steps) + 1
            rows.append((n, "Export", "Export", f"Exported {prev} rows", None, prev, None, int(self.seconds * 1000), None))
        return spark.createDataFrame(rows, STEP_LOG_SCHEMA)


def sequence_ops(df: DataFrame) -> dict[str, Callable]:
    """X6 sequence helpers as DataFrame calls (``any`` = not empty)."""
    return {
        "any": lambda: not df.isEmpty(),
        "count": df.count,
        "first": lambda: df.head(),
        "columns": lambda: list(df.columns),
        "clone": lambda: df.limit(0),
    }


def sort_spec(spec: Sequence[tuple[str, str]]) -> list[Column]:
    """X2 ``"Name ASC, Age DESC"`` as a list of (column, direction)."""
    out = []
    for name, direction in spec:
        d = direction.strip().upper()
        if d not in ("ASC", "DESC"):
            raise ValueError("direction must be ASC or DESC")
        out.append(F.col(name).asc_nulls_first() if d == "ASC" else F.col(name).desc_nulls_last())
    return out
