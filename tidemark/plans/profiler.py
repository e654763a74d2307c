"""Where ticks and time went: of the nodes of a graph, and of the operators of a query's executed plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import Series


#: Profilers that are open; the innermost watches runs.
watching: list[Profiler] = []


@dataclass
class NodeStat:
    """A node of a graph: its ticks and the seconds that computing them from the sources took; or an operator of a plan."""

    name: str
    rows: int
    metrics: dict[str, int]
    seconds: float = 0.0

    @property
    def average(self) -> float:
        """Seconds for each tick."""
        return self.seconds / self.rows if self.rows else 0.0


@dataclass
class ProfilerInfo:
    seconds: float = 0.0
    nodes: list[NodeStat] = field(default_factory=list)

    def node(self, name: str) -> NodeStat:
        """The first node of a name, the number after # left out."""
        return next(n for n in self.nodes if n.name.split("#")[0] == name)

    def print_stats(self, top: int = 10) -> None:
        print(f"{'ticks':>12} {'seconds':>9} {'us a tick':>9} node")
        for n in sorted(self.nodes, key=lambda n: (-n.seconds, -n.rows))[:top]:
            print(f"{n.rows:>12} {n.seconds:>9.3f} {n.average * 1e6:>9.2f} {n.name}")
        print(f"{self.seconds:.3f} s")


class Profiler:
    """with Profiler() as p: run(graph, ...) counts and times each node; p.collect(df) takes the metrics of one query's plan."""

    def __init__(self):
        self.info = ProfilerInfo()

    def __enter__(self) -> Profiler:
        watching.append(self)
        return self

    def __exit__(self, *exc) -> None:
        watching.remove(self)

    def watch(self, series: list[Series]) -> None:
        """A job for each node, which computes its ticks and nothing else; a node's seconds thus have those of its inputs in them."""
        for s in series:
            began = time.perf_counter()
            n = s.ticks().agg(F.count("t")).first()[0]
            took = time.perf_counter() - began
            self.info.seconds += took
            self.info.nodes.append(NodeStat(f"{s.node.op}#{s.node.id}" + ("" if s.out is None else f"[{s.out}]"), n, {}, took))

    def run(self, df: DataFrame) -> int:
        """Runs df to a no-op sink and returns its number of rows."""
        seen, began = Observation(), time.perf_counter()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
        watched.write.format("noop").mode("overwrite").save()
        self.info.seconds += time.perf_counter() - began
        self.info.nodes.append(NodeStat("result", seen.get["n"], {}))
        return seen.get["n"]

    def collect(self, df: DataFrame) -> list:
        """df's rows; the metrics of its plan's operators are added to the info."""
        began = time.perf_counter()
        rows = df.collect()
        self.info.seconds += time.perf_counter() - began
        self._walk(df._jdf.queryExecution().executedPlan())
        return rows

    def _walk(self, plan) -> None:
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return self._walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return self._walk(plan.plan())
        metrics, it = {}, plan.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            metrics[pair._1()] = pair._2().value()
        self.info.nodes.append(NodeStat(plan.nodeName(), metrics.get("numOutputRows", 0), metrics))
        children = plan.children()
        for i in range(children.size()):
            self._walk(children.apply(i))
