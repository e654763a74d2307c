"""Series of ticks, and the frames that hold them.

A `Frame` is a DataFrame with a row for each cycle: key columns, `t` (microsecond time), `cyc` (number of the
cycle among those at one time) and a column for each series on it. A series' cell is a one-field struct, null
where the series didn't tick: a tick whose value is null is thus not the same as no tick. Series that come
from one source stay columns of one frame, however many operators lie between: one scan and one shuffle by
key. Series of different frames meet by `align`, a union and one aggregation, never a join.
"""

from __future__ import annotations

import itertools
from contextvars import ContextVar
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ids = itertools.count()
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Node:
    """A step of the logical graph, for rendering, auditing and profiling."""

    op: str
    inputs: tuple[Node, ...] = ()
    id: int = field(default_factory=lambda: next(_ids))


@dataclass
class Run:
    """What holds during a run: its bounds and what it collects."""

    spark: SparkSession
    start: datetime
    end: datetime
    outputs: dict[str, list[Series]] = field(default_factory=dict)
    series: list[Series] = field(default_factory=list)
    on_stop: list = field(default_factory=list)
    #: Of a live run: the graph that is being wired for the stream, and the adapters that feed it by input name.
    live: object = None
    adapters: dict = field(default_factory=dict)


current: ContextVar[Run | None] = ContextVar("run", default=None)


def running() -> Run:
    run = current.get()
    if run is None:
        raise RuntimeError("this needs a run: call it from a graph function given to run()")
    return run


def utc(moment: datetime) -> datetime:
    """Naive times are UTC."""
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def micros(delta: timedelta) -> int:
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def moment(when: datetime) -> Column:
    return F.timestamp_micros(F.lit(micros(utc(when) - datetime(1970, 1, 1, tzinfo=timezone.utc))))


#: What a frame's maker knows of its cycles: all are number 0; a key has one at most at any time; nothing.
ZERO, ONE, MANY = range(3)


class Frame:
    """Cycles of some keys. Columns are only ever added, so every series on it stays valid."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...] = (), cycles: int = MANY):
        self.df, self.keys, self.cycles = df, tuple(keys), cycles
        self._known: dict[tuple, str] = {}
        #: Cells of series that tick in every row: their latest tick is the row's own.
        self.dense: set[str] = set()

    @property
    def order(self):
        return Window.partitionBy(*self.keys).orderBy("t", "cyc") if self.keys else Window.partitionBy(F.lit(0)).orderBy("t", "cyc")

    @property
    def so_far(self):
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    def add(self, value: Column, key: tuple | None = None) -> str:
        """The name of a new column; with a key, of the same one each time."""
        if key is not None and key in self._known:
            return self._known[key]
        name = f"s{next(_ids)}"
        self.df = self.df.withColumn(name, value)
        if key is not None:
            self._known[key] = name
        return name

    def latest(self, cell: str) -> Column:
        """The last tick's cell, this cycle's included; null until the first."""
        if cell in self.dense:
            return F.col(cell)
        return F.col(self.add(F.last(cell, ignorenulls=True).over(self.so_far), ("latest", cell)))

    def before(self, cell: str) -> Column:
        """The last tick's cell, this cycle's excluded."""
        return F.col(self.add(F.last(cell, ignorenulls=True).over(self.order.rowsBetween(Window.unboundedPreceding, -1)), ("before", cell)))


class Series:
    """A column of a frame. `out` numbers the outputs of a node that has several."""

    def __init__(self, frame: Frame, cell: str, node: Node, out: int | None = None):
        self.frame, self.cell, self.node, self.out = frame, cell, node, out
        run = current.get()
        if run is not None:
            run.series.append(self)

    @property
    def type(self) -> T.DataType:
        return self.frame.df.schema[self.cell].dataType["v"].dataType

    @property
    def ticked(self) -> Column:
        return F.col(self.cell).isNotNull()

    @property
    def value(self) -> Column:
        """The value of this cycle's tick."""
        return F.col(self.cell).getField("v")

    @property
    def valid(self) -> Column:
        return self.frame.latest(self.cell).isNotNull()

    @property
    def now(self) -> Column:
        """The latest value."""
        return self.frame.latest(self.cell).getField("v")

    @property
    def dense(self) -> bool:
        return self.cell in self.frame.dense

    def derive(self, op: str, tick: Column | None, value: Column, *inputs: Series, out: int | None = None, node: Node | None = None) -> Series:
        """A series on this frame that ticks where `tick` holds; without one, in every row."""
        cell = F.struct(value.alias("v"))
        name = self.frame.add(cell if tick is None else F.when(tick, cell))
        if tick is None:
            self.frame.dense.add(name)
        return Series(self.frame, name, node or Node(op, tuple(x.node for x in (inputs or (self,)))), out)

    def ticks(self) -> DataFrame:
        """Its ticks: keys, t, cyc and value, within the run's bounds if there is one."""
        df = self.frame.df.filter(self.ticked).select(*self.frame.keys, "t", "cyc", self.value.alias("value"))
        run = current.get()
        return df.filter((F.col("t") >= moment(run.start)) & (F.col("t") <= moment(run.end))) if run else df

    def numeric(self) -> None:
        if not isinstance(self.type, (*NUMERIC, T.BooleanType)):
            raise ValueError(f"{self.node.op} needs numeric time-series values, not {self.type.simpleString()}")

    # arithmetic and comparison; literals are constants
    def __add__(self, other): return _ops().binary("+", self, other)
    def __radd__(self, other): return _ops().binary("+", other, self)
    def __sub__(self, other): return _ops().binary("-", self, other)
    def __rsub__(self, other): return _ops().binary("-", other, self)
    def __mul__(self, other): return _ops().binary("*", self, other)
    def __rmul__(self, other): return _ops().binary("*", other, self)
    def __truediv__(self, other): return _ops().binary("/", self, other)
    def __rtruediv__(self, other): return _ops().binary("/", other, self)
    def __gt__(self, other): return _ops().binary(">", self, other)
    def __lt__(self, other): return _ops().binary("<", self, other)
    def __ge__(self, other): return _ops().binary(">=", self, other)
    def __le__(self, other): return _ops().binary("<=", self, other)
    def eq(self, other): return _ops().binary("==", self, other)
    def ne(self, other): return _ops().binary("!=", self, other)


def _ops():
    from .operators import basic

    return basic


def series_of(df: DataFrame, value: Column | str, t: str = "t", keys: tuple[str, ...] = (), cyc: Column | None = None, seq: str | None = None, op: str = "source") -> Series:
    """A series from rows; where several rows of a key share a cycle, the last by `seq` wins.

    Without `seq` the rows' cycles must be distinct, and nothing is shuffled.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, F.col(t).cast("timestamp").alias("t"), (F.lit(0) if cyc is None else cyc).cast("int").alias("cyc"), F.struct(value.alias("v")).alias("cell"), *([F.col(seq).alias("seq")] if seq else []))
    rows = rows.filter(F.col("t").isNotNull())
    if seq:
        rows = last_of_cycle(rows, keys, ["cell"], "seq")
    name = f"s{next(_ids)}"
    frame = Frame(rows.select(*keys, "t", "cyc", F.col("cell").alias(name)), keys, ZERO if cyc is None else MANY)
    frame.dense.add(name)
    return Series(frame, name, Node(op))


def last_of_cycle(rows: DataFrame, keys: tuple[str, ...], cells: list[str], order: Column | str) -> DataFrame:
    """One row for each key and cycle, the last by `order`. Rows are dealt by key, as windows over the series need them: one shuffle for both."""
    dealt = rows.repartition(*keys) if keys else rows
    best = F.max_by(F.struct(*cells), order).alias("_last")
    return dealt.groupBy(*keys, "t", "cyc").agg(best).select(*keys, "t", "cyc", *(F.col(f"_last.{c}").alias(c) for c in cells))


def own_cycles(rows: DataFrame, keys: tuple[str, ...], cells: list[str], order: Column | str) -> DataFrame:
    """All rows: those that share a key and cycle follow one another, by `order`, in cycles from that one on. Dealt as by `last_of_cycle`."""
    dealt = rows.repartition(*keys) if keys else rows
    place = F.row_number().over(Window.partitionBy(*keys, "t", "cyc").orderBy(order))
    return dealt.select(*keys, "t", (F.col("cyc") + place - 1).alias("cyc"), *cells)


def align(*series: Series) -> list[Series]:
    """The same series on one frame. Those that share a frame already cost nothing."""
    frames = list(dict.fromkeys(x.frame for x in series))
    if len(frames) == 1:
        return list(series)
    keys = frames[0].keys
    if any(f.keys != keys for f in frames):
        raise ValueError("series with different keys don't meet: " + ", ".join(str(f.keys) for f in frames))
    # new names: two frames may have a column of one name
    cells = {(x.frame, x.cell): f"s{next(_ids)}" for x in series}
    kinds = {name: frame.df.schema[cell].dataType for (frame, cell), name in cells.items()}
    parts = []
    for frame in frames:
        own = {name: cell for (f, cell), name in cells.items() if f is frame}
        any_ticked = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(True)) for c in own.values()), F.lit(False))
        parts.append(frame.df.filter(any_ticked).select(*keys, "t", "cyc", *((F.col(own[n]) if n in own else F.lit(None).cast(kinds[n])).alias(n) for n in cells.values())))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    cycles = ZERO if all(f.cycles == ZERO for f in frames) else MANY
    frame = Frame(union.groupBy(*keys, "t", "cyc").agg(*(F.first(n, ignorenulls=True).alias(n) for n in cells.values())), keys, cycles)
    return [Series(frame, cells[x.frame, x.cell], x.node, x.out) for x in series]
