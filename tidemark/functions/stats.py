"""Rolling statistics over the last N ticks or a trailing time window.

stat(x, interval, min_data_points=1): an int is a number of ticks, a timedelta a window that includes its
lower bound. The output ticks with x, unless the window has fewer than min_data_points ticks.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..model import MANY, Frame, Series, micros


def live(*args, **kwargs):
    from ..operators.basic import live as found

    return found(*args, **kwargs)


def _alone(x: Series) -> Series:
    """x on a frame where every row is a tick of x, as frames of ticks need; the frame itself if it is one."""
    if x.dense:
        return x
    key = ("frame of", x.cell)
    if key not in x.frame._known:
        frame = Frame(x.frame.df.filter(x.ticked), x.frame.keys, x.frame.cycles)
        frame.dense.add(x.cell)
        x.frame._known[key] = frame
    return Series(x.frame._known[key], x.cell, x.node, x.out)


class Rolling:
    """A window over a frame of ticks, and aggregates over it, each a column of the frame that is made once."""

    def __init__(self, frame: Frame, interval: int | timedelta):
        self.frame, self.interval = frame, interval
        if isinstance(interval, timedelta):
            if frame.cycles == MANY:
                # a range would take in later cycles of the same time: earlier times, and the cycles of this time so far
                self.parts = [self._by_time(-micros(interval), -1), Window.partitionBy(*frame.keys, "t").orderBy("cyc").rowsBetween(Window.unboundedPreceding, 0)]
                if not interval:
                    self.parts = self.parts[1:]
            else:
                self.parts = [self._by_time(-micros(interval), 0)]
        elif interval < 1:
            raise ValueError("a window has one tick at least")
        else:
            self.parts = [frame.order.rowsBetween(-(interval - 1), 0)]

    def _by_time(self, first: int, last: int):
        by_key = Window.partitionBy(*self.frame.keys) if self.frame.keys else Window.partitionBy(F.lit(0))
        return by_key.orderBy(F.unix_micros("t")).rangeBetween(first, last)

    def each(self, name: str, cell: str, agg: Callable[[Column], Column]) -> list[Column]:
        """The aggregate over each part."""
        value = F.col(cell).getField("v").cast("double")
        return [F.col(self.frame.add(agg(value).over(w), (name, cell, self.interval, i))) for i, w in enumerate(self.parts)]

    def both(self, name: str, cell: str, agg: Callable[[Column], Column], join: Callable[..., Column]) -> Column:
        found = self.each(name, cell, agg)
        return found[0] if len(found) == 1 else join(*found)

    def ticks(self, cell: str) -> Column:
        found = [F.col(self.frame.add(F.count(cell).over(w), ("ticks", cell, self.interval, i))) for i, w in enumerate(self.parts)]
        return found[0] if len(found) == 1 else found[0] + found[1]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _plus(a: Column, b: Column) -> Column:
    """A sum of what isn't null."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(_zero(a) + _zero(b))


def _count(w: Rolling, cell: str) -> Column:
    return w.both("count", cell, F.count, lambda a, b: a + b)


def _sum(w: Rolling, cell: str) -> Column:
    return w.both("sum", cell, F.sum, _plus)


def _mean(w: Rolling, cell: str) -> Column:
    return w.both("mean", cell, F.avg, lambda a, b: F.try_divide(_sum(w, cell), _count(w, cell)))


def _median(w: Rolling, cell: str) -> Column:
    if len(w.parts) == 1:
        return w.both("median", cell, lambda v: F.percentile(v, F.lit(0.5)), None)
    listed = F.array_sort(F.concat(*w.each("list", cell, F.collect_list)))
    n = F.size(listed)
    return F.when(n > 0, (F.get(listed, F.floor((n - 1) / 2).cast("int")) + F.get(listed, F.floor(n / 2).cast("int"))) / 2)


def _var(w: Rolling, cell: str, ddof: int) -> Column:
    n = _count(w, cell)
    spreads = w.each("var", cell, F.var_pop)
    if len(spreads) == 1:
        total = spreads[0] * n
    else:
        (na, nb), (ma, mb) = w.each("count", cell, F.count), w.each("mean", cell, F.avg)
        total = _zero(spreads[0]) * na + _zero(spreads[1]) * nb + F.when((na > 0) & (nb > 0), (ma - mb) * (ma - mb) * na * nb / n).otherwise(0.0)
    return F.when(n > ddof, total / (n - ddof)).otherwise(F.lit(0.0))


def _stat(name: str, x: Series, interval: int | timedelta, min_data_points: int, build: Callable[[Rolling, str], Column], ddof: int = 1) -> Series:
    if (edge := live("rolling", x, stat=name, interval=interval, min_data_points=min_data_points, ddof=ddof)) is not None:
        return edge
    x = _alone(x)
    x.numeric()
    w = Rolling(x.frame, interval)
    enough = w.ticks(x.cell) >= min_data_points if min_data_points > 1 else None
    return x.derive(f"stats.{name}", enough, build(w, x.cell))


def count(x, interval, min_data_points=1): return _stat("count", x, interval, min_data_points, lambda w, c: _count(w, c).cast("double"))
def sum(x, interval, min_data_points=1): return _stat("sum", x, interval, min_data_points, _sum)  # noqa: A001
def mean(x, interval, min_data_points=1): return _stat("mean", x, interval, min_data_points, _mean)
def min(x, interval, min_data_points=1): return _stat("min", x, interval, min_data_points, lambda w, c: w.both("min", c, F.min, F.least))  # noqa: A001
def max(x, interval, min_data_points=1): return _stat("max", x, interval, min_data_points, lambda w, c: w.both("max", c, F.max, F.greatest))  # noqa: A001
def first(x, interval, min_data_points=1): return _stat("first", x, interval, min_data_points, _first)
def last(x, interval, min_data_points=1): return _stat("last", x, interval, min_data_points, lambda w, c: F.col(c).getField("v").cast("double"))
def prod(x, interval, min_data_points=1): return _stat("prod", x, interval, min_data_points, lambda w, c: w.both("prod", c, F.product, lambda a, b: F.coalesce(a * b, a, b)))
def median(x, interval, min_data_points=1): return _stat("median", x, interval, min_data_points, _median)


def _first(w: Rolling, cell: str) -> Column:
    """The oldest tick's value, which may be null."""
    found = [F.col(w.frame.add(F.first(cell).over(part), ("first", cell, w.interval, i))) for i, part in enumerate(w.parts)]
    return F.coalesce(*found).getField("v").cast("double")


def var(x, interval, ddof=1, min_data_points=1):
    """Variance with divisor n - ddof; 0 where that isn't positive."""
    return _stat("var", x, interval, min_data_points, lambda w, c: _var(w, c, ddof), ddof)


def stddev(x, interval, ddof=1, min_data_points=1):
    return _stat("stddev", x, interval, min_data_points, lambda w, c: F.sqrt(_var(w, c, ddof)), ddof)
