"""Graphs that appear with their keys.

For each new key of a control series a sub-graph is spawned; it doesn't see the tick that spawned it. On Spark
that is one graph for all keys at once, on a frame that has the key as a column, without each key's first tick.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..model import Frame, Node, Series, last_of_cycle, micros, moment, running, utc


class Spawned:
    """What a factory gets: the control's later ticks by key, and when each key was spawned."""

    def __init__(self, ticks: Series, born: Frame):
        self.ticks, self.born = ticks, born

    def const(self, value) -> Series:
        """A tick at spawn time, in the cycle after."""
        df = self.born.df.select(*self.born.keys, "t", (F.col("cyc") + 1).alias("cyc"), F.struct(F.lit(value).alias("v")).alias("cell"))
        return Series(Frame(df, self.born.keys), "cell", Node("const"))

    def timer(self, interval: timedelta, value=True) -> Series:
        """Ticks at spawn time + k intervals, k from 1, to the run's end."""
        us, end = micros(interval), F.unix_micros(moment(running().end))
        first = F.unix_micros("t") + us
        times = F.when(first <= end, F.sequence(first, end, F.lit(us)))
        df = self.born.df.select(*self.born.keys, F.explode(times).alias("us")).select(*self.born.keys, F.timestamp_micros("us").alias("t"), F.lit(0).alias("cyc"), F.struct(F.lit(value).alias("v")).alias("cell"))
        return Series(Frame(df, self.born.keys), "cell", Node("timer"))


    def curve(self, kind: str, data: Iterable[tuple[timedelta | datetime, object]]) -> Series:
        """Replays (offset from the spawn, or time, and value) pairs; what isn't after the spawn comes in the cycle after it. Of several at one time the last in the list stays."""
        run = running()
        points = F.array(*(F.struct(F.lit(micros(at) if isinstance(at, timedelta) else None).cast("long").alias("after"), F.lit(None if isinstance(at, timedelta) else micros(utc(at) - utc(datetime(1970, 1, 1)))).cast("long").alias("at"),
                                    F.lit(i).alias("seq"), F.struct(F.lit(v).cast(kind).alias("v")).alias("cell")) for i, (at, v) in enumerate(data)))
        born = F.unix_micros("t")
        due = F.greatest(F.coalesce(F.col("p.at"), born + F.col("p.after")), born)
        rows = self.born.df.select(*self.born.keys, "t", "cyc", F.explode(points).alias("p")).select(
            *self.born.keys, F.timestamp_micros(due).alias("t"), F.when(due == born, F.col("cyc") + 1).otherwise(F.lit(0)).alias("cyc"), "p.seq", "p.cell").filter(F.col("t") <= moment(run.end))
        frame = Frame(last_of_cycle(rows, self.born.keys, ["cell"], "seq"), self.born.keys)
        frame.dense.add("cell")
        return Series(frame, "cell", Node("curve"))


def dynamic(control: Series, factory: Callable[[Spawned], Series | dict[str, Series]], key: str | None = "k", value: str | None = "v") -> dict[str, Series]:
    """`control` ticks with a bare key (value=None) or a struct of key and value; outputs are keyed by the column `key`."""
    if hasattr(control, "loop"):
        raise ValueError("a live graph isn't dynamic")
    cell = F.col(control.cell).getField("v")
    bare = value is None
    name = key or "k"
    rows = control.frame.df.filter(control.ticked).select(*control.frame.keys, (cell if bare else cell.getField(name)).alias(name), "t", "cyc", F.struct((cell if bare else cell.getField(value)).alias("v")).alias("cell"))
    frame = Frame(rows, (*control.frame.keys, name))
    n = F.col(frame.add(F.row_number().over(frame.order)))
    later = Series(frame, frame.add(F.when(n > 1, F.col("cell"))), Node("dynamic", (control.node,)))
    born = Frame(rows.groupBy(*frame.keys).agg(F.min(F.struct("t", "cyc")).alias("b")).select(*frame.keys, "b.t", "b.cyc"), frame.keys)
    made = factory(Spawned(later, born))
    return made if isinstance(made, dict) else {"out": made}
