"""Running a graph function over a span of time."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Run, Series, current, moment, utc
from ..operators.feedback import Loop
from ..shipping import shared_folder
from ..sinks.tables import audit
from . import profiler


class PythonInPlan(ValueError):
    """A native run's plan holds Python."""


def build(graph, *args, starttime: datetime | None = None, endtime: datetime | timedelta | None = None, spark: SparkSession | None = None, live: bool = False, **kwargs) -> Run:
    """Wires the graph; nothing is read or run. Without an end only what is due at the start ticks."""
    start = utc(starttime) if starttime is not None else datetime.now(timezone.utc)
    end = start if endtime is None else start + endtime if isinstance(endtime, timedelta) else utc(endtime)
    if end < start:
        raise ValueError("the end is before the start")
    made = Run(spark or SparkSession.builder.getOrCreate(), start, end, live=Loop() if live else None)
    token = current.set(made)
    try:
        graph(*args, **kwargs)
    finally:
        current.reset(token)
    return made


def run(graph, *args, starttime: datetime | None = None, endtime: datetime | timedelta | None = None, realtime: bool = False, native: bool = False, persist: str | None = None,
        late_after: timedelta = timedelta(seconds=1), spark: SparkSession | None = None, **kwargs) -> dict[str, DataFrame]:
    """Outputs by name, each a DataFrame of keys, t, cyc and value within [start, end].

    realtime: on the wall clock, fed by push adapters; returns when the end has passed. late_after: how long after its stamp a
    pushed tick may arrive. native: refuse a plan that needs Python workers. persist: a folder ending in .jsonl or .csv for the
    audit of all ticks. Outputs are computed when they are used; where callbacks wait for the run's end, they are computed
    first, into tables of the shared folder.
    """
    if persist and not persist.endswith((".jsonl", ".csv")):
        raise ValueError("the audit is written as .jsonl or .csv")
    if persist and (native or realtime):
        raise ValueError("a native or live run has no audit")
    if native and realtime:
        raise ValueError("a live run needs Python workers")
    if realtime and endtime is None:
        raise ValueError("a live run needs an end")
    if not realtime and starttime is None:
        raise ValueError("a run needs a start")
    made = build(graph, *args, starttime=starttime, endtime=endtime, spark=spark, live=realtime, **kwargs)
    if persist and any(s.node.op == "dynamic" for s in made.series):
        raise ValueError("a dynamic graph has no audit")
    token = current.set(made)
    try:
        if realtime:
            from ..streaming.live_run import run_live

            found = run_live(made, late_after)
        else:
            found = {name: _together(xs) for name, xs in made.outputs.items()}
            if native:
                for name, df in found.items():
                    require_native(df, name)
            if made.on_stop:
                found = {name: _computed(df, name) for name, df in found.items()}
            if persist:
                rows = audit(distinct(made.series))
                writer = rows.write.mode("overwrite")
                writer.json(persist) if persist.endswith(".jsonl") else writer.option("header", True).csv(persist)
            if profiler.watching:
                profiler.watching[-1].watch(distinct(made.series))
        for callback in made.on_stop:
            try:
                callback()
            except Exception as e:  # the others still run
                print(f"on stop: {e}")
        return found
    finally:
        current.reset(token)


def _computed(df: DataFrame, name: str) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/tidemark-output-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Stepper:
    """A run in steps: `step` moves on to a time and gives the ticks since the last step, `outputs` all ticks so far."""

    def __init__(self, graph, *args, **kwargs):
        self.whole, self.run = None, build(graph, *args, **kwargs)
        token = current.set(self.run)
        try:
            self.whole = {name: _together(xs) for name, xs in self.run.outputs.items()}
        finally:
            current.reset(token)
        self.at: datetime | None = None

    def step(self, to: datetime | timedelta) -> dict[str, DataFrame]:
        last, to = self.at, utc(self.run.start) + to if isinstance(to, timedelta) else utc(to)
        if last is not None and to < last:
            raise ValueError("time doesn't go back")
        self.at = to
        return {k: df if last is None else df.filter(F.col("t") > moment(last)) for k, df in self.outputs().items()}

    def outputs(self) -> dict[str, DataFrame]:
        if self.at is None:
            return {k: df.limit(0) for k, df in self.whole.items()}
        return {k: df.filter(F.col("t") <= moment(self.at)) for k, df in self.whole.items()}


def begin(graph, *args, starttime: datetime, endtime: datetime | timedelta | None = None, spark: SparkSession | None = None, **kwargs) -> Stepper:
    return Stepper(graph, *args, starttime=starttime, endtime=endtime, spark=spark, **kwargs)


def _together(xs: list[Series]) -> DataFrame:
    out = xs[0].ticks()
    for x in xs[1:]:
        out = out.unionByName(x.ticks())
    return out


def distinct(series: list[Series]) -> list[Series]:
    """One series for each output of each step: aligning makes others of the same."""
    return list({(s.node.id, s.out): s for s in reversed(series)}.values())[::-1]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def require_native(df: DataFrame, name: str = "the query") -> None:
    """Raises where a plan would start Python workers."""
    text = plan_text(df)
    for sign in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsIn", "PythonUDTF"):
        if sign in text:
            raise PythonInPlan(f"{name} isn't native: its plan has {sign}")
