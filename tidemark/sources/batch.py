"""Sources that replay: constants, timers, curves, frames, files, and keyed adapters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MANY, ONE, Frame, Node, Series, _ids, last_of_cycle, micros, moment, own_cycles, running, series_of, utc


def _live():
    from ..streaming import operators

    return operators


def const(value) -> Series:
    """One tick at the start."""
    run = running()
    if run.live is not None:
        return _live().const(value)
    df = run.spark.range(1).select(moment(run.start).alias("t"), F.lit(value).alias("v"))
    return series_of(df, "v", op="const")


def timer(interval: timedelta, value=True) -> Series:
    """Ticks at start + k intervals, k from 1, up to the end."""
    run, us = running(), micros(interval)
    if us <= 0:
        raise ValueError("a timer needs a positive interval")
    if run.live is not None:
        return _live().timer(interval, value)
    n = max(0, micros(utc(run.end) - utc(run.start)) // us)
    df = run.spark.range(1, n + 1).select(F.timestamp_micros(F.unix_micros(moment(run.start)) + F.col("id") * us).alias("t"), F.lit(value).alias("v"))
    return series_of(df, "v", op="timer")


def placed(df: DataFrame, t: str, cells: dict, keys: tuple[str, ...], seq: str | None, each: bool = False) -> Frame:
    """Cells (name: value) as a frame. Points in the past come now; those at the start or before are in the cycle after the
    constants; beyond the end none. Of a key's points in one cycle the last by `seq` stays; without one, that of the latest
    own time and then the greatest values as text, so that every run takes the same. With `each` all stay, in that order
    in cycles of their own.
    """
    run = running()
    if run.live is not None:
        raise ValueError("the sources of a live run are push adapters, const, timer and curve")
    start, end = moment(run.start), moment(run.end)
    when = F.col(t).cast("timestamp")
    order = [F.col(seq)] if seq else [F.unix_micros(when), *(F.to_json(F.struct(v.alias("v"))) for v in cells.values())]
    rows = df.select(*keys, F.greatest(when, start).alias("t"), (when <= start).cast("int").alias("cyc"), *(F.struct(v.alias("v")).alias(n) for n, v in cells.items()), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("_order"), when.alias("_when"))
    rows = rows.filter(F.col("_when").isNotNull() & (F.col("t") <= end))
    if each:
        frame = Frame(own_cycles(rows, keys, list(cells), F.struct("_when", "_order")), keys, MANY)
    else:
        frame = Frame(last_of_cycle(rows, keys, list(cells), "_order"), keys, ONE)
    frame.dense |= set(cells)
    return frame


def clamped(df: DataFrame, t: str, value, keys: tuple[str, ...], seq: str | None, op: str, each: bool = False) -> Series:
    """One series of `placed` points."""
    name = f"s{next(_ids)}"
    return Series(placed(df, t, {name: value}, keys, seq, each), name, Node(op))


def curve(kind: str, data: Iterable[tuple[timedelta | datetime, object]]) -> Series:
    """Replays (offset or time, value) pairs; of several at one time the last in the list stays."""
    run = running()
    start = utc(run.start)
    if run.live is not None:
        # past points come now
        return _live().source(kind, [(max(timedelta(0), at if isinstance(at, timedelta) else utc(at) - start), v) for at, v in data])
    rows = [(utc(start + at if isinstance(at, timedelta) else at), i, v) for i, (at, v) in enumerate(data)]
    df = run.spark.createDataFrame(rows, f"t timestamp, seq long, v {kind}")
    return clamped(df, "t", F.col("v"), (), "seq", "curve")


def curve_from_frame(df: DataFrame, value_col: str, time_col: str, keys: tuple[str, ...] = (), seq: str | None = None) -> Series:
    """A curve from a DataFrame; `seq` orders rows that share a time."""
    return clamped(df, time_col, F.col(value_col), tuple(keys), seq, "curve")


def read_frame(df: DataFrame, time_col: str, value_cols: list[str] | None = None, keys: tuple[str, ...] = (), seq: str | None = None) -> dict[str, Series]:
    """A series for each column, all on one frame. A null cell is a tick whose value is null. Of a key's rows at one time the last
    by `seq` ticks; a table has no order of its own, so without `seq` the choice is fixed but arbitrary, see `placed`."""
    names = value_cols or [c for c in df.columns if c not in (time_col, seq) and c not in keys]
    cells = {c: f"s{next(_ids)}" for c in names}
    frame = placed(df, time_col, {cells[c]: F.col(c) for c in names}, tuple(keys), seq)
    return {c: Series(frame, cells[c], Node(f"read.{c}")) for c in names}


def read_parquet(path: str, time_col: str, value_cols: list[str] | None = None, keys: tuple[str, ...] = (), seq: str | None = None) -> dict[str, Series]:
    return read_frame(running().spark.read.parquet(path), time_col, value_cols, keys, seq)


def read_csv(path: str, time_col: str, value_cols: list[str] | None = None, keys: tuple[str, ...] = (), schema: str | None = None, seq: str | None = None) -> dict[str, Series]:
    reader = running().spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return read_frame(df, time_col, value_cols, keys, seq)


class AdapterManager:
    """Rows (time, key, value) as keyed series. `subscribe(key)` gives the same series each time; an unknown key's never ticks.
    Of a key's rows at one time the last ticks; with `each` all do, by `seq`, in cycles of their own."""

    def __init__(self, df: DataFrame, time_col: str = "time", key_col: str = "key", value_col: str = "value", seq: str | None = None, each: bool = False):
        self.df, self.key, self.each = df, key_col, each
        self.columns = (time_col, value_col, seq)
        self._made: dict = {}

    def keys(self) -> DataFrame:
        return self.df.select(self.key).distinct()

    def all(self) -> Series:
        """All keys at once, the key a column: what scales."""
        t, v, seq = self.columns
        return self._made.setdefault(None, clamped(self.df, t, F.col(v), (self.key,), seq, "adapter", self.each))

    def subscribe(self, key) -> Series:
        t, v, seq = self.columns
        if key not in self._made:
            self._made[key] = clamped(self.df.filter(F.col(self.key) == F.lit(key)), t, F.col(v), (), seq, f"adapter[{key}]", self.each)
        return self._made[key]


class ReplayAdapterManager(AdapterManager):
    """From (time, key, value) tuples in memory, in list order at equal times."""

    def __init__(self, rows: Iterable[tuple], kind: str = "double"):
        listed = [(utc(t), str(k), v, i) for i, (t, k, v) in enumerate(rows)]
        super().__init__(running().spark.createDataFrame(listed, f"time timestamp, key string, value {kind}, seq long"), seq="seq")


class CsvAdapterManager(AdapterManager):
    """From a CSV or Parquet file; `seq_col` orders rows that share a key and a time."""

    def __init__(self, path: str, time_col: str, key_col: str, value_col: str, seq_col: str | None = None):
        read = running().spark.read
        df = read.parquet(path) if path.rstrip("/").endswith(".parquet") else read.option("header", True).option("inferSchema", True).csv(path)
        super().__init__(df, time_col, key_col, value_col, seq_col)
