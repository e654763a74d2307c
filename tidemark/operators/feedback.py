"""Feedback edges: an edge that is usable before what produces it exists.

    loop = feedback("long")
    orders = algo(loop.out(), quotes)     # nodes on the loop's edges
    reports = exchange(orders)
    loop.bind(reports)                    # comes back in the next cycle of the same time

A loop is sequential by nature. Nodes that read a loop's edge, directly or not, are gathered and run together for
each key, in the order they were wired; `bind` closes the loop, and its edges are series from then on.
"""

from __future__ import annotations

from ..functions.node import Circuit, Step, fold_frame
from ..model import Node, Series, current

_FED = "fed"


def _binary(op: str, x, y):
    from .basic import binary

    return binary(op, x, y)


class LoopEdge:
    """An output of a node on a loop, or (step None) the edge that is fed back. Once the loop is closed, `series` is what it gives."""

    def __init__(self, loop: Loop, step: int | None, out: str):
        self.loop, self.step, self.out = loop, step, out

    @property
    def series(self) -> Series:
        return self.loop.series(self)

    # the same algebra as a series
    def __add__(self, other): return _binary("+", self, other)
    def __radd__(self, other): return _binary("+", other, self)
    def __sub__(self, other): return _binary("-", self, other)
    def __rsub__(self, other): return _binary("-", other, self)
    def __mul__(self, other): return _binary("*", self, other)
    def __rmul__(self, other): return _binary("*", other, self)
    def __truediv__(self, other): return _binary("/", self, other)
    def __rtruediv__(self, other): return _binary("/", other, self)
    def __gt__(self, other): return _binary(">", self, other)
    def __lt__(self, other): return _binary("<", self, other)
    def __ge__(self, other): return _binary(">=", self, other)
    def __le__(self, other): return _binary("<=", self, other)
    def eq(self, other): return _binary("==", self, other)
    def ne(self, other): return _binary("!=", self, other)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.series, name)


class Loop:
    def __init__(self):
        self.steps: list[Step] = []
        self.outs: dict[tuple[int, str], str] = {}
        #: Of a live graph, all of which is one loop: (step, output, input) of what is fed back.
        self.back: list[tuple[int, str, str]] = []
        self._frame = None

    def add(self, step: Step, outs: dict[str, str]) -> dict[str, LoopEdge]:
        if self._frame is not None:
            raise ValueError("the loop is closed")
        self.steps.append(step)
        n = len(self.steps) - 1
        self.outs |= {(n, k): kind for k, kind in outs.items()}
        return {k: LoopEdge(self, n, k) for k in outs}

    def wired(self, outside: dict[str, Series]) -> list[Step]:
        """The steps with the origin of each input; series from outside the loop are named and added to `outside`."""

        def origin(x) -> tuple:
            if isinstance(x, LoopEdge):
                return ("in", x.out) if x.step is None else ("step", x.step, x.out)
            name = next((k for k, s in outside.items() if s is x), f"in{len(outside)}")
            outside[name] = x
            return ("in", name)

        return [Step(s.body, {k: origin(x) for k, x in s.inputs.items()}, s.outs, s.scalars, s.alarms, s.name) for s in self.steps]

    @property
    def columns(self) -> dict[str, str]:
        """All outputs of all steps, as columns, and their types."""
        return {f"o{n}_{k}": kind for (n, k), kind in self.outs.items()}

    def close(self, edge: LoopEdge) -> None:
        outside: dict[str, Series] = {}
        steps = self.wired(outside)
        names, back = list(outside), [(edge.step, edge.out, _FED)]
        self._nodes: dict[int, Node] = {}
        self._frame = fold_frame(outside, self.columns, lambda start_us, end_us: Circuit(steps, names, back, start_us, end_us))
        self._from = tuple(s.node for s in outside.values())

    def series(self, edge: LoopEdge) -> Series:
        if self._frame is None:
            raise ValueError("bind the feedback before its edges are used")
        if edge.step is None:
            raise ValueError("the feedback edge itself is only an input of its loop")
        step = self.steps[edge.step]
        node = self._nodes.setdefault(edge.step, Node(step.name, self._from))
        return Series(self._frame, f"o{edge.step}_{edge.out}", node, step.outs.index(edge.out) if len(step.outs) > 1 else None)


class Feedback:
    def __init__(self, kind: str):
        run = current.get()
        self.kind, self._bound, self._live = kind, False, run is not None and run.live is not None
        self._loop = run.live if self._live else Loop()
        self._name = f"{_FED}{len(self._loop.back)}" if self._live else _FED

    def out(self) -> LoopEdge:
        return LoopEdge(self._loop, None, self._name)

    def bind(self, edge: LoopEdge) -> None:
        if self._bound:
            raise ValueError("a feedback is bound once")
        if not isinstance(edge, LoopEdge) or edge.loop is not self._loop or edge.step is None:
            raise ValueError("a feedback is bound to an output of a node on its loop")
        self._bound = True
        if self._live:
            self._loop.back.append((edge.step, edge.out, self._name))
        else:
            self._loop.close(edge)


def feedback(kind: str = "double") -> Feedback:
    return Feedback(kind)


__all__ = ["Feedback", "LoopEdge", "feedback"]
