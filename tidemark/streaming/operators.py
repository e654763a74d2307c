"""Operators as nodes, for streams: the same semantics as the batch operators, one cycle at a time.

A stream can't have windows over ticks, so each operator is a small stateful body for `stream_node`. State is
bounded: rolling statistics keep their window's ticks, all others a few values.
"""

from __future__ import annotations

import math
import operator as o
from collections import deque
from datetime import timedelta
from statistics import median as middle

from ..functions.node import Outputs, alarm_value, alarmed, node, now, output, schedule_alarm, starting, state, ticked, ts, valid


@node(returns="long")
def count(x: ts[object]):
    s = state(n=0)
    s.n += 1
    return s.n


@node(returns="double")
def first_n(x: ts[float], n: int):
    s = state(n=0)
    s.n += 1
    return x.value if s.n <= n else None


@node(returns="double")
def gate(flag: ts[bool], x: ts[float]):
    """filter: x's ticks while the latest flag holds."""
    return x.value if ticked(x) and flag.value else None


@node(returns=Outputs(true="double", false="double"))
def split(flag: ts[bool], x: ts[float]):
    if ticked(x) and valid(flag):
        output(**{"true" if flag.value else "false": x.value})


@node(returns="double")
def sample(trigger: ts[object], x: ts[float]):
    return x.value if ticked(trigger) and valid(x) else None


@node(returns="double")
def merge(x: ts[float], y: ts[float]):
    return x.value if ticked(x) else y.value


@node(returns="double", alarms=("due",))
def delay(x: ts[float], by: timedelta):
    if ticked(x):
        schedule_alarm("due", by, x.value)
    return alarm_value("due") if alarmed("due") else None


_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b),
}


@node(returns="double")
def binary(x: ts[float], y: ts[float], op: str):
    return _BINARY[op](float(x.value), float(y.value)) if valid(x, y) else None


@node(returns="double")
def binary_with(x: ts[float], y: float, op: str, left: bool):
    """With a literal on the right, or (left False) on the left."""
    a, b = float(x.value), float(y)
    return _BINARY[op](a, b) if left else _BINARY[op](b, a)


_COMPARE = {">": o.gt, "<": o.lt, ">=": o.ge, "<=": o.le, "==": o.eq, "!=": o.ne}


@node(returns="boolean")
def compare(x: ts[float], y: ts[float], op: str):
    return _COMPARE[op](float(x.value), float(y.value)) if valid(x, y) else None


@node(returns="boolean")
def compare_with(x: ts[float], y: float, op: str, left: bool):
    a, b = float(x.value), float(y)
    return _COMPARE[op](a, b) if left else _COMPARE[op](b, a)


_STATS = {
    "count": lambda v, ddof: float(len(v)), "sum": lambda v, ddof: math.fsum(v), "mean": lambda v, ddof: math.fsum(v) / len(v), "min": lambda v, ddof: min(v), "max": lambda v, ddof: max(v),
    "first": lambda v, ddof: v[0], "last": lambda v, ddof: v[-1], "prod": lambda v, ddof: math.prod(v), "median": lambda v, ddof: float(middle(v)),
    "var": lambda v, ddof: _var(v, ddof), "stddev": lambda v, ddof: math.sqrt(_var(v, ddof)),
}


def _var(v: list[float], ddof: int) -> float:
    if len(v) <= ddof:
        return 0.0
    m = math.fsum(v) / len(v)
    return math.fsum((a - m) ** 2 for a in v) / (len(v) - ddof)


@node(returns="double")
def rolling(x: ts[float], stat: str, interval: int | timedelta, min_data_points: int = 1, ddof: int = 1):
    """A rolling statistic over the last ticks or a trailing time, its lower bound included."""
    s = state(held=deque())
    s.held.append((now(), float(x.value)))
    if isinstance(interval, timedelta):
        while s.held[0][0] < now() - interval:
            s.held.popleft()
    elif len(s.held) > interval:
        s.held.popleft()
    return _STATS[stat]([v for _, v in s.held], ddof) if len(s.held) >= min_data_points else None


def source(kind: str, points) -> object:
    """A node without inputs that ticks at offsets from the run's start: points gives (offset, value) pairs, of which one at no offset ticks in the next cycle."""

    def body():
        s = state(first=True)
        if s.first:
            s.first = False
            for at, value in points:
                schedule_alarm("due", at, value)
        return alarm_value("due")

    return node(body, returns=kind, alarms=("due",))()


def kind_of(value) -> str:
    return {bool: "boolean", int: "long", float: "double"}.get(type(value), "string")


def const(value):
    def const():
        return value if starting() else None

    return node(const, returns=kind_of(value), alarms=("start",))()


def timer(interval: timedelta, value=True):
    def timer():
        due = alarmed("due")
        schedule_alarm("due", interval)
        return value if due else None

    return node(timer, returns=kind_of(value), alarms=("due",))()


def applied(fn, xs: tuple, returns: str):
    """A function of plain values of any number of edges."""
    from ..functions.node import Step

    def body(**inputs):
        return fn(*(x.value for x in inputs.values())) if valid(*inputs.values()) else None

    loop = next(x.loop for x in xs if hasattr(x, "loop"))
    edges = {f"x{i}": x for i, x in enumerate(xs)}
    return loop.add(Step(body, edges, ["out"], {}, (), "apply"), {"out": returns})["out"]
