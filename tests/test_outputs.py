"""Sinks, audits, rendering, profiles, streams and topics."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.node import Outputs, node, output, state, ticked, ts
from tidemark.operators import basic as op
from tidemark.operators.feedback import feedback
from tidemark.plans.profiler import Profiler
from tidemark.plans.run import run
from tidemark.plans.viz import graph_to_dot, graph_to_mermaid, show_graph, topology
from tidemark.sinks.tables import add_graph_output, print_node, schedule_on_engine_stop, to_long, to_wide, write_csv, write_parquet
from tidemark.sources.batch import const, curve, read_csv, read_frame, read_parquet, timer
from tidemark.streaming.live import FolderBroker, GenericPushAdapter, KafkaAdapterManager, NativePushAdapter, audited
from tidemark.streaming.stateful import run_available

START, SEC = datetime(2020, 1, 1), timedelta(seconds=1)


def simple():
    c = op.count(timer(SEC))
    add_graph_output("n", c)
    add_graph_output("even", op.filter(op.apply(lambda v: v % 2 == 0, c), c))


def test_long_and_wide(spark):
    found = run(simple, starttime=START, endtime=3 * SEC, spark=spark)
    assert sorted((r.name, r.value) for r in to_long(found).collect()) == [("even", 2), ("n", 1), ("n", 2), ("n", 3)]
    assert [(r.n, r.even) for r in to_wide(found).orderBy("time").collect()] == [(1, None), (2, 2), (3, None)]


def test_a_name_used_twice(spark):
    def graph():
        add_graph_output("x", timer(SEC, 1))
        add_graph_output("x", timer(2 * SEC, 2))

    assert sorted(r.value for r in run(graph, starttime=START, endtime=2 * SEC, spark=spark)["x"].collect()) == [1, 1, 2]


def test_files_round_trip(spark, tmp_path):
    def write():
        x = curve("double", [(i * SEC, float(i)) for i in range(1, 5)])
        write_parquet(f"{tmp_path}/p", price=x)
        write_csv(f"{tmp_path}/c", price=x, twice=x * 2)

    run(write, starttime=START, endtime=5 * SEC, spark=spark)

    def read():
        add_graph_output("p", read_parquet(f"{tmp_path}/p", "time")["price"])
        add_graph_output("c", read_csv(f"{tmp_path}/c", "time", ["twice"])["twice"])

    found = run(read, starttime=START, endtime=5 * SEC, spark=spark)
    assert [r.value for r in found["p"].orderBy("t").collect()] == [1, 2, 3, 4]
    assert [r.value for r in found["c"].orderBy("t").collect()] == [2, 4, 6, 8]


def test_audit_and_rejections(spark, tmp_path):
    run(simple, starttime=START, endtime=2 * SEC, spark=spark, persist=f"{tmp_path}/a.jsonl")
    rows = spark.read.json(f"{tmp_path}/a.jsonl").collect()
    assert {r.node.split("#")[0] for r in rows} >= {"timer", "count", "apply", "filter"}
    assert ("2020-01-01T00:00:02.000000", "2") in {(r.time, r.value) for r in rows if r.node.startswith("count#")}
    with pytest.raises(ValueError):
        run(simple, starttime=START, endtime=SEC, spark=spark, persist="x.parquet")
    with pytest.raises(ValueError):
        run(simple, starttime=START, endtime=SEC, spark=spark, persist="x.csv", native=True)


def test_callbacks_and_print(spark, capsys):
    seen = []

    def graph():
        print_node("n", op.count(timer(SEC)))
        schedule_on_engine_stop(lambda: 1 / 0)
        schedule_on_engine_stop(lambda: seen.append(1))

    run(graph, starttime=START, endtime=SEC, spark=spark)
    assert seen == [1] and "1577836801.000000000 n 1" in capsys.readouterr().out


def test_without_an_end_only_the_start(spark):
    found = run(simple, starttime=START, spark=spark)
    assert found["n"].count() == 0


def test_rendering(spark, tmp_path):
    args = {"starttime": START, "endtime": SEC, "spark": spark}
    nodes, edges = topology(simple, **args)
    ops = [o for _, o in nodes]
    assert {"timer", "count", "apply", "filter", "output n"} <= set(ops) and all(a < b for a, b in edges)
    assert "rankdir" in graph_to_dot(simple, **args) and graph_to_mermaid(simple, **args).startswith("graph LR")
    assert show_graph(simple, filename=f"{tmp_path}/g.png", **args).endswith("g.dot")


def test_profiler(spark):
    found = run(simple, starttime=START, endtime=5 * SEC, spark=spark)
    with Profiler() as p:
        assert p.run(found["n"]) == 5 and len(p.collect(found["n"])) == 5
    assert p.info.seconds > 0 and any(n.rows == 5 for n in p.info.nodes)
    p.info.print_stats(2)


def test_push_adapters(spark, tmp_path):
    a = GenericPushAdapter("long", f"{tmp_path}/a")
    for i in range(5):
        a.push_tick(i)
    rows = run_available(a.out(spark), "pushed").orderBy("t").collect()
    assert [r.value for r in rows] == [0, 1, 2, 3, 4] and len({r.t for r in rows}) == 5
    b = NativePushAdapter("double", f"{tmp_path}/b", capacity=2, every=None)
    assert [b.push_tick(1.0), b.push_tick(2.0), b.push_tick(3.0)] == [True, True, False] and b.flush() == 2
    with pytest.raises(ValueError):
        NativePushAdapter("string", f"{tmp_path}/c")


def test_topics(spark, tmp_path):
    broker = FolderBroker(f"{tmp_path}/broker")
    broker.preload("in", [{"px": 1}, {"px": 2}, {"px": 3}])
    m = KafkaAdapterManager(spark, broker)
    q = m.publish("out", m.subscribe("in", "px long").select((F.col("px") * 10).alias("px")), checkpoint=f"{tmp_path}/ck")
    q.awaitTermination()
    assert sorted(json.loads(x)["px"] for x in broker.messages("out")) == [10, 20, 30]


def test_audited_stream(spark, tmp_path):
    a = GenericPushAdapter("long", f"{tmp_path}/a")
    a.push_all([7, 8])
    q = audited(a.out(spark), "push", f"{tmp_path}/audit", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.read.json(f"{tmp_path}/audit").collect()) == ["7", "8"]


@node(returns="double")
def total(x: ts[float]):
    s = state(t=0.0)
    s.t += x.value
    return s.t


def test_fold_taken_up_again():
    import pickle

    first, whole = total.folding(), total.folding()
    rows = [(i * 10, 0, [(float(i),)]) for i in range(6)]
    got = [x for r in rows[:3] for x in first.feed(*r)]
    again = total.folding()
    again.memory = pickle.loads(pickle.dumps(first.memory))
    got += [x for r in rows[3:] for x in again.feed(*r)]
    assert got == [x for r in rows for x in whole.feed(*r)]


def test_live_run(spark, tmp_path):
    """Two adapters, pushed to from another thread, and a clock."""
    import threading
    import time

    whole, native = GenericPushAdapter("long", f"{tmp_path}/whole"), NativePushAdapter("double", f"{tmp_path}/native")
    assert not whole.wait_for_start(0.01)

    def push():
        assert whole.wait_for_start(60)
        for i in range(6):
            whole.push_tick(i)
            native.push_tick(i / 4)
            time.sleep(0.1)

    def graph():
        x, y = whole.out(), native.out()
        assert x.out == whole.out().out
        loop = feedback("long")
        down = countdown(op.firstN(x, 1), loop.out())
        add_graph_output("down", down)
        loop.bind(down)
        add_graph_output("count", op.count(x))
        add_graph_output("sum", x + y)
        add_graph_output("clock", op.count(timer(SEC)))
        add_graph_output("fixed", op.merge(const(1.5), curve("double", [(0 * SEC, 2.5), (SEC, 3.5)])))
        add_graph_output("applied", op.apply(lambda a: a * 10, x, returns="long"))
        with pytest.raises(ValueError):
            read_frame(spark.range(1), "id")

    pushing = threading.Thread(target=push)
    pushing.start()
    found = run(graph, endtime=10 * SEC, realtime=True, spark=spark)
    pushing.join()
    got = {k: [r.value for r in df.orderBy("t", "cyc").collect()] for k, df in found.items()}
    assert got["count"] == [1, 2, 3, 4, 5, 6] and got["applied"] == [0, 10, 20, 30, 40, 50] and got["fixed"] == [1.5, 2.5, 3.5]
    assert got["clock"] == list(range(1, 11)) and got["sum"][-1] == 6.25 and got["down"] == [2, 1, 0]
    with pytest.raises(RuntimeError):
        whole.out()
    with pytest.raises(ValueError):
        run(graph, starttime=START, realtime=True, spark=spark)


@node(returns="long")
def countdown(x: ts[int], back: ts[int]):
    n = back.value if ticked(back) else 3
    return n - 1 if n else None


def test_producers_and_consumers(spark, tmp_path):
    broker = FolderBroker(f"{tmp_path}/broker")
    early, late = broker.consumer("t"), None
    p = broker.producer()
    for m in ({"a": 1}, "plain text", b"[2]", '"quoted"'):
        p.send("t", m)
    late = broker.consumer("t", latest=True)
    p.send("t", 7)
    p.close()
    assert early.poll() == [("t", x) for x in ({"a": 1}, "plain text", [2], "quoted", 7)] and early.poll() == []
    assert late.poll() == [("t", 7)]
    rows = run_available(KafkaAdapterManager(spark, broker).subscribe("t").select("value", F.col("decoded").cast("string").alias("text")), "decoded").collect()
    assert sorted((r.value, r.text) for r in rows) == [('"quoted"', "quoted"), ("7", "7"), ("[2]", "[2]"), ("plain text", "plain text"), ('{"a": 1}', '{"a":1}')]


def test_profile_of_nodes(spark):
    with Profiler() as p:
        run(simple, starttime=START, endtime=6 * SEC, spark=spark)
    assert [p.info.node(n).rows for n in ("timer", "count", "apply", "filter")] == [6, 6, 6, 3]
    assert all(n.seconds > 0 and n.average > 0 for n in p.info.nodes) and p.info.seconds >= p.info.node("count").seconds


def test_audit_of_all_outputs(spark, tmp_path):
    @node(returns=Outputs(low="long", high="long"))
    def halves(n: ts[int]):
        output(low=n.value // 2, high=n.value - n.value // 2)

    def graph():
        both = halves(op.count(timer(SEC)))
        add_graph_output("sum", both.low + both.high)

    run(graph, starttime=START, endtime=3 * SEC, spark=spark, persist=f"{tmp_path}/a.csv")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/a.csv").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.time):
        by.setdefault(r.node.partition("#")[0] + r.node.partition("[")[1] + r.node.partition("[")[2], []).append(r.value)
    assert by["halves[0]"] == ["0", "1", "1"] and by["halves[1]"] == ["1", "1", "2"] and by["+"] == ["1", "2", "3"]


def test_callbacks_come_after_the_outputs(spark):
    seen = spark.sparkContext.accumulator(0)

    @node(returns="long")
    def counted(n: ts[int]):
        seen.add(1)
        return n.value

    at_stop = []

    def graph():
        add_graph_output("n", counted(op.count(timer(SEC))))
        schedule_on_engine_stop(lambda: at_stop.append(seen.value))

    assert run(graph, starttime=START, endtime=4 * SEC, spark=spark)["n"].count() == 4 and at_stop == [4]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.shipping import shared_folder

    def session(master, set_=None, own=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: own, setCheckpointDir=lambda p: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: set_), sparkContext=context)

    assert shared_folder(session("yarn", "hdfs:/x/")) == "hdfs:/x"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))


def test_late_rows_wait_by_bucket():
    """A timer takes the seconds that the watermark has passed, rows of one time as one, and leaves the others untouched."""
    from types import SimpleNamespace

    from tidemark.streaming import stateful

    class Value:
        def __init__(self):
            self.v = None

        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v

    class Map(dict):
        reads = 0

        def containsKey(self, k): return k in self
        def updateValue(self, k, v): self[k] = v
        def removeKey(self, k): del self[k]

        def getValue(self, k):
            self.reads += 1
            return self[k]

    import pandas as pd

    timers = []
    states = SimpleNamespace(rows=Map(), waiting=Value(), kept=Value(), handle=SimpleNamespace(registerTimer=timers.append))
    own = stateful.Folded(states, total.folding, {}, ["k"], ["x"], ["out"])
    us = [5_200_000, 1_500_000, 1_500_000, 9_000_000, 1_100_000]
    own.take([pd.DataFrame({"us": us, "x": [{"v": float(i)} for i in range(5)]})])
    assert timers == [2000] and sorted(k for (k,) in states.rows) == [1, 5, 9]
    got = own.fold(("a",), 6_500_000)
    assert got["out"].tolist() == [4.0, 6.0, 6.0] and got["us"].tolist() == [1_100_000, 1_500_000, 5_200_000]
    assert states.rows.reads == 2 and list(states.rows) == [(9,)] and timers[-1] == 10_000
