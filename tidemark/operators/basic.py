"""Stream operators: arithmetic, comparison, filter, sample, merge, count, firstN, delay, split, apply."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ONE, ZERO, Frame, Node, Series, align, micros


def live(name: str, *edges, **scalars):
    """The operator as a node, where an edge is on a loop or a live graph; else None."""
    if not any(hasattr(x, "loop") for x in edges):
        return None
    from ..streaming import operators

    return getattr(operators, name)(*edges, **scalars)


def _with_literals(*xs) -> tuple[list[Series], list[Column], list[Column]]:
    """Operands on one frame: the series, each operand's latest value, and what must be valid. A literal is a constant that never ticks again."""
    aligned = iter(align(*(x for x in xs if isinstance(x, Series))))
    series, values, valid = [], [], []
    for x in xs:
        if isinstance(x, Series):
            s = next(aligned)
            series.append(s)
            values.append(s.now)
            valid.append(s.valid)
        else:
            values.append(F.lit(x))
    return series, values, valid


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def _fires(series: list[Series], valid: list[Column]) -> Column | None:
    """Any ticked and all are valid; None where that is so in every row."""
    return None if all(s.dense for s in series) else _any([s.ticked for s in series]) & _all(valid)


def _kind(x) -> T.DataType:
    return x.type if isinstance(x, Series) else {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(x), T.StringType())


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def binary(op: str, x, y) -> Series:
    """Fires when either side ticks and both are valid. Integers stay integers for + - * and wrap; / is always a double;
    a division by zero and comparisons with NaN follow IEEE 754."""
    if hasattr(x, "loop") and hasattr(y, "loop"):
        return live("binary" if op in "+-*/" else "compare", x, y, op=op)
    if hasattr(x, "loop") or hasattr(y, "loop"):
        left = hasattr(x, "loop")
        return live("binary_with" if op in "+-*/" else "compare_with", x if left else y, y=y if left else x, op=op, left=left)
    for s in (x, y):
        if isinstance(s, Series):
            s.numeric()
        elif not isinstance(s, (bool, int, float)):
            raise ValueError(f"{op} needs numeric time-series values, not {s!r}")
    integral = op in "+-*" and all(isinstance(_kind(s), _INTEGRAL) for s in (x, y))
    series, (a, b), valid = _with_literals(x, y)
    as_double = lambda c, s: (c.cast("int") if isinstance(_kind(s), T.BooleanType) else c).cast("double")
    if integral:
        value = wrapping(op, a.cast("long"), b.cast("long"))
    else:
        a, b = as_double(a, x), as_double(b, y)
        value = ieee(op, a, b)
    return series[0].derive(op, _fires(series, valid), value, *(s for s in (x, y) if isinstance(s, Series)))


def wrapping(op: str, a: Column, b: Column) -> Column:
    """64-bit integer arithmetic that wraps: exact in decimals, then brought into range."""
    exact = {"+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b)}[op]()
    wide = lambda c: c.cast("decimal(38,0)")
    total = {"+": lambda: wide(a) + wide(b), "-": lambda: wide(a) - wide(b), "*": lambda: wide(a) * wide(b)}[op]()
    half, full = F.lit(Decimal(2**63)), F.lit(Decimal(2**64))
    return F.coalesce(exact, (F.pmod(total + half, full) - half).cast("long"))


def ieee(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when((a > 0) == (F.lit(1.0) == F.signum(_sign_of_zero(b))), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    nan = F.isnan(a) | F.isnan(b)
    holds = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}[op]
    return F.when(nan, F.lit(op == "!=")).otherwise(holds)


def _sign_of_zero(b: Column) -> Column:
    """-1 for a negative zero, else 1."""
    return F.when(b.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))


def truthy(value: Column, kind: T.DataType) -> Column:
    """Non-zero numbers, true and non-empty strings hold."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(kind, (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)):
        return F.coalesce(value != 0, F.lit(False))
    return value.isNotNull()


def filter(flag: Series, x: Series) -> Series:
    """x's ticks while the latest flag holds; a flag that hasn't ticked doesn't."""
    if (edge := live("gate", flag, x)) is not None:
        return edge
    f, s = align(flag, x)
    return s.derive("filter", s.ticked & truthy(f.now, f.type), s.value, flag, x)


def sample(trigger: Series, x: Series) -> Series:
    """On each tick of the trigger, x's latest value, a tick in the same cycle included."""
    if (edge := live("sample", trigger, x)) is not None:
        return edge
    tr, s = align(trigger, x)
    return s.derive("sample", tr.ticked & s.valid, s.now, trigger, x)


def merge(x: Series, y: Series) -> Series:
    """Ticks of both; x's where both tick in a cycle."""
    if (edge := live("merge", x, y)) is not None:
        return edge
    a, b = align(x, y)
    return a.derive("merge", a.ticked | b.ticked, F.coalesce(F.col(a.cell), F.col(b.cell)).getField("v"), x, y)


def count(x: Series) -> Series:
    """1, 2, 3, ... on x's ticks."""
    if (edge := live("count", x)) is not None:
        return edge
    n = F.count(x.cell).over(x.frame.so_far)
    return x.derive("count", None if x.dense else x.ticked, n)


def firstN(x: Series, n: int) -> Series:  # noqa: N802
    """The first n ticks."""
    if (edge := live("first_n", x, n=n)) is not None:
        return edge
    k = F.col(x.frame.add(F.count(x.cell).over(x.frame.so_far)))
    return x.derive("firstN", x.ticked & (k <= n), x.value)


def delay(x: Series, delta: timedelta) -> Series:
    """x's ticks, later by delta; without a delay, in the next cycle of the same time. Ticks beyond the run's end are dropped."""
    us = micros(delta)
    if us < 0:
        raise ValueError("a delay can't be negative")
    if (edge := live("delay", x, by=delta)) is not None:
        return edge
    df = x.frame.df.filter(x.ticked).select(*x.frame.keys, F.timestamp_micros(F.unix_micros("t") + us).alias("t"), (F.col("cyc") + (0 if us else 1)).alias("cyc"), F.col(x.cell))
    if us:  # whatever cycles they were in, they are one cycle at the later time; the last wins
        df = df.groupBy(*x.frame.keys, "t").agg(F.max_by(x.cell, "cyc").alias(x.cell)).select(*x.frame.keys, "t", F.lit(0).alias("cyc"), x.cell)
    frame = Frame(df, x.frame.keys, ZERO if us else max(x.frame.cycles, ONE))
    frame.dense.add(x.cell)
    return Series(frame, x.cell, Node("delay", (x.node,)))


class Split(NamedTuple):
    true: Series
    false: Series


def split(flag: Series, x: Series) -> Split:
    """x's ticks by the latest flag; nothing until the flag ticked."""
    if (edge := live("split", flag, x)) is not None:
        return edge
    f, s = align(flag, x)
    held = truthy(f.now, f.type)
    node = Node("split", (flag.node, x.node))
    return Split(s.derive("", s.ticked & f.valid & held, s.value, out=0, node=node), s.derive("", s.ticked & f.valid & ~held, s.value, out=1, node=node))


def apply(fn: Callable[..., Column], *xs: Series, total: bool = False, returns: str = "double") -> Series:
    """fn of the latest values, as a column expression; fires when any ticks and all are valid. A null result is no tick;
    `total` says that there is none. On a live graph fn gets plain values and its result is of the type `returns`."""
    if any(hasattr(x, "loop") for x in xs):
        from ..streaming.operators import applied

        return applied(fn, xs, returns)
    series, values, valid = _with_literals(*xs)
    fires = _fires(series, valid)
    if total:
        return series[0].derive("apply", fires, fn(*values), *xs)
    value = F.col(series[0].frame.add(fn(*values)))
    return series[0].derive("apply", value.isNotNull() if fires is None else fires & value.isNotNull(), value, *xs)


def difference(x: Series, percent: bool = False) -> Series:
    """Change from the tick before; the first tick gives none."""
    last = x.frame.before(x.cell)
    change = x.value - last.getField("v")
    return x.derive("pct_change" if percent else "difference", x.ticked & last.isNotNull(), change / last.getField("v") if percent else change)


def cumulative(x: Series, how: str = "sum", split: timedelta | None = None) -> Series:
    """Running sum, mean, min or max of x's ticks.

    split: for a sum over few keys, or none. Its periods are summed in tasks of their own, so that no task holds a key's ticks.
    """
    if split is not None:
        if how != "sum":
            raise ValueError("only sums are split")
        from ..plans.prefix import running_total

        rows = x.frame.df.filter(x.ticked).select(*x.frame.keys, "t", "cyc", x.value.alias("_x"))
        frame = Frame(running_total(rows, x.frame.keys, "_x", split, "_total"), x.frame.keys, x.frame.cycles)
        name = frame.add(F.struct(F.col("_total").alias("v")))
        frame.dense.add(name)
        return Series(frame, name, Node("running_sum", (x.node,)))
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
    return x.derive(f"running_{how}", None if x.dense else x.ticked, fn(x.value).over(x.frame.so_far))


def rekeyed(x: Series, keys: tuple[str, ...]) -> Series:
    """The same ticks with fewer or other key columns of the frame; several of a cycle become one, the last by the dropped keys."""
    dropped = [k for k in x.frame.keys if k not in keys]
    df = x.frame.df.filter(x.ticked).groupBy(*keys, "t", "cyc").agg(F.max_by(x.cell, F.struct(*dropped)).alias(x.cell)) if dropped else x.frame.df
    return Series(Frame(df, keys, x.frame.cycles), x.cell, x.node, x.out)
