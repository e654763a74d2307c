"""Nodes: stateful functions of ticks, called once for each cycle in which an input or an alarm ticks.

    @node(returns="double", alarms=("beat",))
    def running(x: ts[float], scale: float):
        s = state(total=0.0)
        if ticked(x):
            s.total += x.value
        return s.total * scale

Arguments annotated `ts[...]` are series, all others are set when the graph is built. A key's cycles are folded
in order within one task, streamed from a sorted partition: what a worker holds is one key's state and one
batch of rows. Where windows or columns can say the same, they are faster; this is for what they can't.

Outputs named in `feedback` are re-injected on an input in the next cycle of the same time.
"""

from __future__ import annotations

import heapq
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MANY, Frame, Node, Series, align, current, micros, utc
from ..shipping import ship
from ..sources.batch import const

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class ts:  # noqa: N801
    """Marks a parameter as a series: ts[float]."""

    def __class_getitem__(cls, item):
        return type("ts", (ts,), {"item": item})


class Outputs:
    """Named outputs of a node and their Spark types: Outputs(pos="double", neg="double")."""

    def __init__(self, **types: str):
        self.types = types


class _Call:
    """What a body sees of its key: the cycle being run, and what it keeps."""

    def __init__(self):
        self.now_us, self.first, self.values, self.ticks, self.known, self.alarm, self.set, self.memory, self.out = 0, True, {}, set(), set(), {}, [], None, {}


_call: list[_Call] = []


class Input:
    """The latest value of an input; algebra applies to the value."""

    __slots__ = ("name",)

    def __init__(self, name: str):
        self.name = name

    @property
    def value(self):
        return _call[-1].values.get(self.name)

    def __float__(self): return float(self.value)
    def __int__(self): return int(self.value)
    def __bool__(self): return bool(self.value)
    def __str__(self): return str(self.value)
    def __neg__(self): return -self.value
    def __abs__(self): return abs(self.value)
    def __hash__(self): return hash(self.name)


def _algebra():
    import operator as o

    def forward(f):
        return lambda self, other: f(self.value, other.value if isinstance(other, Input) else other)

    def reflected(f):
        return lambda self, other: f(other, self.value)

    for name in ("add", "sub", "mul", "truediv", "floordiv", "mod"):
        setattr(Input, f"__{name}__", forward(getattr(o, name)))
        setattr(Input, f"__r{name}__", reflected(getattr(o, name)))
    for name in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(Input, f"__{name}__", forward(getattr(o, name)))


_algebra()


def ticked(*xs: Input) -> bool:
    """Whether any ticked in this cycle."""
    return any(x.name in _call[-1].ticks for x in xs)


def valid(*xs: Input) -> bool:
    """Whether all have ever ticked."""
    return all(x.name in _call[-1].known for x in xs)


def output(*value, **named) -> None:
    """Emits; of several on one output the last wins."""
    for v in value:
        _call[-1].out[""] = v
    _call[-1].out.update(named)


def state(**start) -> SimpleNamespace:
    """This key's memory, made on first use."""
    c = _call[-1]
    if c.memory is None:
        c.memory = SimpleNamespace(**start)
    return c.memory


def starting() -> bool:
    return _call[-1].first


def now() -> datetime:
    return _EPOCH + timedelta(microseconds=_call[-1].now_us)


def schedule_alarm(name: str, after: timedelta, value=True) -> None:
    c = _call[-1]
    c.set.append((c.now_us + micros(after), name, value))


def alarmed(name: str) -> bool:
    return name in _call[-1].alarm


def alarm_value(name: str):
    return _call[-1].alarm.get(name)


@dataclass
class Step:
    """A node of a circuit: where each input comes from, ("in", name) or ("step", number, output)."""

    body: Callable
    inputs: dict[str, tuple]
    outs: list[str]
    scalars: dict
    alarms: tuple[str, ...] = ()
    name: str = "node"


class Circuit:
    """One key's cycles through some nodes, in order. What is between two feeds can be pickled (`memory`) and taken up by another worker.

    names: the inputs that rows bring; feedback: (number, output, input) of what comes back in the next cycle of the same time.
    """

    def __init__(self, steps: list[Step], names: list[str], feedback: list[tuple[int, str, str]], start_us: int | None = None, end_us: int | None = None):
        self.steps, self.names, self.feedback, self.end_us = steps, names, feedback, end_us
        self.args = [{k: Input(k) for k in s.inputs} | s.scalars for s in steps]
        self.calls, self.last, self.queue, self.seq = [_Call() for _ in steps], (None, -1), [], 0
        for i, s in enumerate(steps):
            if s.alarms and start_us is not None:
                self._queue(start_us, i, "", None)

    @property
    def memory(self) -> tuple:
        return [c.__dict__ for c in self.calls], self.last, self.queue, self.seq

    @memory.setter
    def memory(self, kept: tuple) -> None:
        for c, x in zip(self.calls, kept[0]):
            c.__dict__.update(x)
        _, self.last, self.queue, self.seq = kept

    def _queue(self, t: int, step: int, name: str, value) -> None:
        """An alarm of a step, or with -1 an input."""
        self.seq += 1
        heapq.heappush(self.queue, (t, self.seq, step, name, value))

    def _cycle(self, t: int, least: int, cells: dict, alarms: dict[int, dict]) -> Iterator[tuple]:
        cyc = max(least, self.last[1] + 1 if self.last[0] == t else 0)
        self.last, emitted = (t, cyc), {}
        for i, (step, c) in enumerate(zip(self.steps, self.calls)):
            own = {k: cells[at[1]] if at[0] == "in" else emitted[at[1:]] for k, at in step.inputs.items() if (at[1] in cells if at[0] == "in" else at[1:] in emitted)}
            if not own and i not in alarms:
                continue
            c.now_us, c.alarm, c.out, c.ticks = t, alarms.get(i, {}), {}, set(own)
            c.values.update(own)
            c.known |= set(own)
            _call.append(c)
            try:
                got = step.body(**self.args[i])
            finally:
                _call.pop()
            c.first = False
            for when, name, value in c.set:
                self._queue(when, i, name, value)
            c.set = []
            if got is not None:
                c.out[""] = got
            alone = len(step.outs) == 1 and "" in c.out
            emitted |= {(i, k): c.out[k if k in c.out else ""] for k in step.outs if k in c.out or alone}
        for i, k, name in self.feedback:
            if (i, k) in emitted:
                self._queue(t, -1, name, emitted[i, k])
        if emitted:
            yield t, cyc, [(emitted[i, k],) if (i, k) in emitted else None for i, s in enumerate(self.steps) for k in s.outs]

    def in_bounds(self) -> bool:
        """Whether an alarm or feedback is still to come before the end."""
        return bool(self.queue) and (self.end_us is None or self.queue[0][0] <= self.end_us)

    def _taken(self, t: int) -> tuple[dict, dict[int, dict]]:
        cells, alarms = {}, {}
        while self.queue and self.queue[0][0] == t:
            _, _, step, name, value = heapq.heappop(self.queue)
            (cells if step < 0 else alarms.setdefault(step, {}))[name] = value
        return cells, alarms

    def due(self, before: int | None = None) -> Iterator[tuple]:
        """Cycles of alarms and feedback that come before a time; without one, all up to the end."""
        while self.in_bounds() and (before is None or self.queue[0][0] < before):
            yield from self._cycle(self.queue[0][0], 0, *self._taken(self.queue[0][0]))

    def feed(self, t: int, cyc: int, cells: list) -> Iterator[tuple]:
        """A row: cells are (value,) or None, one for each name. Yields (t, cyc, cells of all outputs)."""
        if self.end_us is not None and t > self.end_us:
            return
        yield from self.due(t)
        back, alarms = self._taken(t)
        yield from self._cycle(t, cyc, back | {k: v[0] for k, v in zip(self.names, cells) if v is not None}, alarms)


def fold_frame(named: dict[str, Series], outs: dict[str, str], make: Callable[[int | None, int | None], Circuit], timed: bool = True) -> Frame:
    """A circuit for each key of some series, as a frame with a cell column for each output (name: Spark type).

    timed: there are alarms or feedback, so that cycles come up which the inputs don't have.
    """
    # without a series there is still the run's start
    series = align(*(named.values() or [const(0)]))
    keys, run = series[0].frame.keys, current.get()
    span = (micros(utc(run.start) - _EPOCH), micros(utc(run.end) - _EPOCH)) if run else (None, None)
    ticked_rows = series[0].frame.df.filter(F.coalesce(*(F.when(s.ticked, F.lit(True)) for s in series), F.lit(False)))
    rows = ticked_rows.select(*keys, F.unix_micros("t").alias("t"), "cyc", *(F.col(s.cell).isNotNull().alias(f"{n}_ticked") for s, n in zip(series, named)), *(s.value.alias(n) for s, n in zip(series, named)))
    ship(rows.sparkSession)
    # a number of its own: small partitions aren't put together, as a fold's work isn't in its bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(parts, *keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "t", "cyc")
    cells = [T.StructField(k, T.StructType([T.StructField("v", T._parse_datatype_string(kind))])) for k, kind in outs.items()]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("t", T.LongType()), T.StructField("cyc", T.IntegerType()), *cells])
    n, width = len(keys), len(named)

    def run_all(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch():
            columns = list(zip(*held))
            arrays = [pa.array(list(x), f.type) for x, f in zip(columns, arrow)][:n + 2]
            for x, f in zip(columns[n + 2:], list(arrow)[n + 2:]):
                values = pa.array([None if c is None else c[0] for c in x], f.type.field(0).type)
                arrays.append(pa.StructArray.from_arrays([values], fields=[f.type.field(0)], mask=pa.array([c is None for c in x])))
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def ticks():
            key, own = None, None
            for b in batches:
                columns = [col.to_pylist() for col in b.columns]
                cells = zip(*([(v,) if t else None for t, v in zip(columns[n + 2 + k], columns[n + 2 + width + k])] for k in range(width))) if width else iter(lambda: (), None)
                for *row_key, t, cyc, row in zip(*columns[:n + 2], cells):
                    if own is None or row_key != key:
                        if own is not None:
                            yield from ((key, x) for x in own.due())
                        key, own = row_key, make(*span)
                    yield from ((key, x) for x in own.feed(t, cyc, row))
            if own is not None:
                yield from ((key, x) for x in own.due())

        held = []
        for key, (t, cyc, found) in ticks():
            held.append((*key, t, cyc, *found))
            if len(held) >= 10_000:
                yield batch()
                held = []
        if held:
            yield batch()

    return Frame(rows.mapInArrow(run_all, schema).withColumn("t", F.timestamp_micros("t")), keys, MANY if timed else series[0].frame.cycles)


def schedules(body: Callable) -> bool:
    """Whether a body may set alarms: its code or that of functions in it names `schedule_alarm`."""
    code = [body.__code__] if hasattr(body, "__code__") else []
    while code:
        c = code.pop()
        if "schedule_alarm" in c.co_names:
            return True
        code += [x for x in c.co_consts if hasattr(x, "co_names")]
    return not hasattr(body, "__code__")


_SPARK = {float: "double", int: "long", bool: "boolean", str: "string"}


def _returned(signature: inspect.Signature):
    """Outputs as the return annotation has them: ts[float], or Outputs(a=ts[int])."""
    hint = signature.return_annotation
    if isinstance(hint, Outputs):
        return Outputs(**{k: _SPARK[v.item] if isinstance(v, type) and issubclass(v, ts) else v for k, v in hint.types.items()})
    if isinstance(hint, type) and issubclass(hint, ts):
        return _SPARK[hint.item]
    return "double"


def node(fn=None, *, returns: str | Outputs | None = None, alarms: tuple[str, ...] = (), feedback: dict[str, str] | None = None):
    """Makes a function of series from a body. `returns`: the Spark type of its output, or Outputs (else as annotated: `-> ts[float]`);
    `feedback`: outputs and the inputs they feed."""
    if fn is None:
        return lambda f: node(f, returns=returns, alarms=alarms, feedback=feedback)
    try:
        signature = inspect.signature(fn, eval_str=True)
    except NameError:
        signature = inspect.signature(fn)
    returns = returns if returns is not None else _returned(signature)
    outs = returns.types if isinstance(returns, Outputs) else {"out": returns}
    fed_by = {("out" if k == "" else k): v for k, v in (feedback or {}).items()}
    hints = {k: p.annotation for k, p in signature.parameters.items()}
    inputs = [k for k, h in hints.items() if (isinstance(h, type) and issubclass(h, ts)) or (isinstance(h, str) and h.startswith("ts["))]
    names = [k for k in inputs if k not in fed_by.values()]

    def made(frame: Frame, step: Node):
        found = [Series(frame, k, step, i if len(outs) > 1 else None) for i, k in enumerate(outs)]
        return SimpleNamespace(**dict(zip(outs, found))) if isinstance(returns, Outputs) else found[0]

    def circuit(scalars: dict):
        steps, back = [Step(fn, {k: ("in", k) for k in inputs}, list(outs), scalars, alarms, fn.__name__)], [(0, k, v) for k, v in fed_by.items()]
        return lambda start_us=None, end_us=None: Circuit(steps, names, back, start_us, end_us)

    def wired(*args, **kwargs):
        bound = signature.bind_partial(*args, **kwargs)
        bound.apply_defaults()
        scalars = {k: v for k, v in bound.arguments.items() if k not in inputs}
        given = {k: bound.arguments[k] for k in names}
        loop = next((x.loop for x in given.values() if hasattr(x, "loop")), None)
        if loop is None and (run := current.get()) is not None:
            loop = run.live
        if loop is not None:
            found = loop.add(Step(fn, given, list(outs), scalars, alarms, fn.__name__), outs)
            return SimpleNamespace(**found) if isinstance(returns, Outputs) else found["out"]
        return made(fold_frame(given, outs, circuit(scalars), bool(alarms or fed_by or schedules(fn))), Node(fn.__name__, tuple(s.node for s in given.values())))

    def folding(start_us: int | None = None, end_us: int | None = None, **scalars) -> Circuit:
        """A fold of one key, for a stream's state."""
        bound = signature.bind_partial(**scalars)
        bound.apply_defaults()
        return circuit({k: v for k, v in bound.arguments.items() if k not in inputs})(start_us, end_us)

    wired.__name__, wired.__doc__, wired.folding, wired.outs, wired.inputs = fn.__name__, fn.__doc__, folding, outs, names
    return wired


def graph(fn):
    """Marks a function that wires a graph; it stays a plain function."""
    fn.is_graph = True
    return fn
