"""Operators against plain loops over random ticks."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.node import Outputs, alarm_value, alarmed, node, now, output, schedule_alarm, starting, state, ticked, ts, valid
from tidemark.model import MANY, ONE, ZERO, series_of
from tidemark.operators import basic as op
from tidemark.operators.dynamic import dynamic
from tidemark.operators.feedback import feedback
from tidemark.plans.run import PythonInPlan, begin, run
from tidemark.sinks.tables import add_graph_output
from tidemark.sources.batch import AdapterManager, CsvAdapterManager, ReplayAdapterManager, const, curve, read_frame, timer

START, SEC = datetime(2021, 6, 1, 8), timedelta(seconds=1)
SPAN = 40


def ran(spark, graph, seconds=SPAN, **kwargs):
    """(seconds from the start, value) of each output, in order."""
    found = run(graph, starttime=START, endtime=seconds * SEC, spark=spark, **kwargs)
    return {k: [((r.t - START).total_seconds(), r.value) for r in df.orderBy("t", "cyc").collect()] for k, df in found.items()}


def gauge(seed, share=0.5, whole=False):
    """Levels read at some of the seconds."""
    rng = random.Random(seed)
    return [(t, rng.randint(-20, 20) if whole else round(rng.uniform(-5, 5), 2)) for t in range(1, SPAN) if rng.random() < share]


def replayed(levels, kind="double"):
    return curve(kind, [(t * SEC, v) for t, v in levels])


def together(x, y):
    """(time, x's tick or None, y's tick or None, latest x, latest y) of each time at which one ticks."""
    xs, ys, a, b = dict(x), dict(y), None, None
    for t in sorted({*xs, *ys}):
        a, b = xs.get(t, a), ys.get(t, b)
        yield t, xs.get(t), ys.get(t), a, b


@pytest.mark.parametrize("seed", range(3))
def test_two_series(spark, seed):
    x, y = gauge(seed), gauge(seed + 100, 0.3)
    rows = list(together(x, y))
    fires = [(t, a, b) for t, _, _, a, b in rows if a is not None and b is not None]
    want = {
        "add": [(t, a + b) for t, a, b in fires], "sub": [(t, a - b) for t, a, b in fires], "mul": [(t, a * b) for t, a, b in fires], "above": [(t, a > b) for t, a, b in fires], "same": [(t, a == b) for t, a, b in fires],
        "gate": [(t, p) for t, p, _, _, b in rows if p is not None and b is not None and b > 0], "sample": [(t, a) for t, _, q, a, _ in rows if q is not None and a is not None],
        "merge": [(t, p if p is not None else q) for t, p, q, _, _ in rows], "rising": [(t, p) for t, p, _, _, b in rows if p is not None and b is not None and b > 0], "falling": [(t, p) for t, p, _, _, b in rows if p is not None and b is not None and b <= 0],
        "apply": [(t, abs(a) + abs(b)) for t, a, b in fires],
    }

    def graph():
        p, q = replayed(x), replayed(y)
        parts = op.split(q > 0, p)
        for name, s in {"add": p + q, "sub": p - q, "mul": p * q, "above": p > q, "same": p.eq(q), "gate": op.filter(q > 0, p), "sample": op.sample(q, p), "merge": op.merge(p, q), "rising": parts.true, "falling": parts.false,
                        "apply": op.apply(lambda a, b: F.abs(a) + F.abs(b), p, q)}.items():
            add_graph_output(name, s)

    got = ran(spark, graph)
    for name in want:
        assert [t for t, _ in got[name]] == [t for t, _ in want[name]], name
        assert [v for _, v in got[name]] == pytest.approx([v for _, v in want[name]]), name


def test_one_series(spark):
    x = gauge(7, whole=True)

    def graph():
        p = replayed(x, "long")
        for name, s in {"count": op.count(p), "first": op.firstN(p, 4), "late": op.delay(p, 3.5 * SEC), "minus": 100 - p, "third": p / 3, "twice": (p + p) + (p - 1), "change": op.difference(p), "total": op.cumulative(p), "split": op.cumulative(p, split=5 * SEC)}.items():
            add_graph_output(name, s)

    got, values = ran(spark, graph), [v for _, v in x]
    assert got["count"] == [(t, i + 1) for i, (t, _) in enumerate(x)] and got["first"] == x[:4]
    assert got["late"] == [(t + 3.5, v) for t, v in x if t + 3.5 <= SPAN]
    assert got["minus"] == [(t, 100 - v) for t, v in x] and [v for _, v in got["third"]] == pytest.approx([v / 3 for v in values])
    assert got["twice"] == [(t, 3 * v - 1) for t, v in x]
    assert got["change"] == [(t, v - w) for (t, v), w in zip(x[1:], values)]
    assert got["total"] == got["split"] == [(t, sum(values[:i + 1])) for i, (t, _) in enumerate(x)]


def test_clocks(spark):
    def graph():
        add_graph_output("slow", timer(7 * SEC, "tick"))
        add_graph_output("both", op.merge(timer(10 * SEC, 1), timer(4 * SEC, 2)))
        add_graph_output("once", const(2.5))

    got = ran(spark, graph)
    assert got["slow"] == [(t, "tick") for t in range(7, SPAN + 1, 7)] and got["once"] == [(0, 2.5)]
    assert got["both"] == [(t, 1 if t % 10 == 0 else 2) for t in range(1, SPAN + 1) if t % 10 == 0 or t % 4 == 0]


def test_points_before_the_start_after_the_end_and_at_one_time(spark):
    points = [(-9 * SEC, 1), (-3 * SEC, 2), (8 * SEC, 3), (5 * SEC, 4), (8 * SEC, 5), ((SPAN + 1) * SEC, 6), (5 * SEC, 7)]
    assert ran(spark, lambda: add_graph_output("x", curve("long", points)))["x"] == [(0, 2), (5, 7), (8, 5)]


def test_const_and_curve_at_start_are_two_cycles(spark):
    def graph():
        add_graph_output("product", op.binary("*", const(6), curve("long", [(0 * SEC, 7)])))
        add_graph_output("merged", op.merge(const(6), curve("long", [(0 * SEC, 7)])))

    got = ran(spark, graph)
    assert got["product"] == [(0, 42)] and got["merged"] == [(0, 6), (0, 7)]


@pytest.mark.parametrize("seq", [None, "seq"])
def test_rows_of_one_time_are_one_tick(spark, tmp_path, seq):
    """Of a frame, a file and an adapter; past rows all come at the start."""
    rng = random.Random(5)
    rows = [(START + rng.choice([-4, -2, 3, 3, 9, 11]) * SEC, rng.choice("ab"), i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "time timestamp, key string, seq long, level double")
    df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.option("header", True).csv(f"{tmp_path}/rows")
    last = {}
    for t, k, i, v in rows:
        last[k, max(START, t)] = max(last.get((k, max(START, t)), (-1, 0)), (i, v))

    def graph():
        cols = read_frame(df, "time", ["level"], keys=("key",), seq=seq)
        add_graph_output("frame", cols["level"])
        add_graph_output("count", op.count(cols["level"]))
        manager = CsvAdapterManager(f"{tmp_path}/rows", "time", "key", "level", seq_col="seq")
        add_graph_output("csv", manager.all())
        add_graph_output("one", manager.subscribe("a"))

    found = run(graph, starttime=START, endtime=SPAN * SEC, spark=spark)
    times = {(r.key, r.t): r.value for r in found["frame"].collect()}
    assert len(times) == found["frame"].count() and set(times) == set(last)
    assert sorted(r.value for r in found["count"].filter("key = 'a'").collect()) == list(range(1, sum(k == "a" for k, _ in last) + 1))
    if seq:
        assert times == {k: v for k, (_, v) in last.items()}
        assert {(r.key, r.t): r.value for r in found["csv"].collect()} == times
        assert {r.t: r.value for r in found["one"].collect()} == {t: v for (k, t), v in times.items() if k == "a"}


def test_zero_delay_is_the_next_cycle(spark):
    def graph():
        x = replayed([(3, 4), (6, 9)], "long")
        add_graph_output("merged", op.merge(x, op.delay(x, 0 * SEC) * 10))

    assert ran(spark, graph)["merged"] == [(3, 4), (3, 40), (6, 9), (6, 90)]


def test_what_is_known_of_cycles(spark):
    def graph():
        x, y = replayed([(1, 1.0)]), timer(SEC, 2.0)
        assert y.frame.cycles == ZERO and x.frame.cycles == ONE and op.delay(x, SEC).frame.cycles == ZERO
        assert op.delay(y, 0 * SEC).frame.cycles == ONE and op.merge(x, y).frame.cycles == MANY and op.merge(y, timer(SEC, 1.0)).frame.cycles == ZERO

    run(graph, starttime=START, endtime=SEC, spark=spark)


def test_negative_delay(spark):
    with pytest.raises(ValueError):
        run(lambda: op.delay(timer(SEC), -SEC), starttime=START, endtime=SEC, spark=spark)


def test_null_tick_is_a_tick(spark):
    def graph():
        x = curve("double", [(4 * SEC, None), (5 * SEC, 0.5), (7 * SEC, None)])
        add_graph_output("count", op.count(x))
        add_graph_output("apply", op.apply(lambda v: v * 4, x))

    got = ran(spark, graph)
    assert got["count"] == [(4, 1), (5, 2), (7, 3)] and got["apply"] == [(5, 2.0)]


def test_ieee_and_wrapping(spark):
    def graph():
        x = replayed([(1, 8.0), (2, -0.5), (3, 0.0), (4, float("nan"))])
        add_graph_output("div", x / 0)
        add_graph_output("eq", x.eq(x))
        add_graph_output("lt", x < 1)
        add_graph_output("wrap", replayed([(1, -(2**63))], "long") - 1)
        add_graph_output("wrap2", replayed([(1, 2**61)], "long") * 8)

    got = {k: [v for _, v in x] for k, x in ran(spark, graph).items()}
    assert got["div"][:2] == [math.inf, -math.inf] and all(math.isnan(v) for v in got["div"][2:])
    assert got["eq"] == [True, True, True, False] and got["lt"] == [False, True, True, False]
    assert got["wrap"] == [2**63 - 1] and got["wrap2"] == [0]


def test_only_numbers_have_arithmetic(spark):
    with pytest.raises(ValueError, match="needs numeric"):
        ran(spark, lambda: add_graph_output("x", replayed([(1, "low")], "string").ne(replayed([(1, "high")], "string"))))


def spread(values, ddof):
    n = len(values)
    return sum((v - sum(values) / n) ** 2 for v in values) / (n - ddof) if n > ddof else 0.0


STATS = {
    "count": lambda v: float(len(v)), "sum": sum, "mean": lambda v: sum(v) / len(v), "min": min, "max": max, "first": lambda v: v[0], "last": lambda v: v[-1], "prod": math.prod, "median": statistics.median,
    "var": lambda v: spread(v, 1), "stddev": lambda v: math.sqrt(spread(v, 1)),
}


@pytest.mark.parametrize("name", STATS)
@pytest.mark.parametrize("twice", [False, True])
def test_rolling_statistics(spark, name, twice):
    """Over ticks and over time, of a series with a cycle for each time, and of one with two."""
    x = gauge(11, 0.6)
    ticks = [c for t, v in x for c in ([(t, v), (t, v + 1)] if twice else [(t, v)])]

    def graph():
        p = replayed(x)
        p = op.merge(p, op.delay(p + 1, 0 * SEC)) if twice else p
        add_graph_output("ticks", getattr(stats, name)(p, 4))
        add_graph_output("time", getattr(stats, name)(p, 3 * SEC))
        add_graph_output("enough", getattr(stats, name)(p, 3 * SEC, min_data_points=3))
        add_graph_output("now", getattr(stats, name)(p, 0 * SEC))

    got, reduce = ran(spark, graph), STATS[name]
    windows = [[v for u, v in ticks[:i + 1] if u >= t - 3] for i, (t, _) in enumerate(ticks)]
    assert [v for _, v in got["ticks"]] == pytest.approx([reduce([v for _, v in ticks[max(0, i - 3):i + 1]]) for i in range(len(ticks))])
    assert got["time"] == [(t, pytest.approx(reduce(w))) for (t, _), w in zip(ticks, windows)]
    assert got["enough"] == [(t, pytest.approx(reduce(w))) for (t, _), w in zip(ticks, windows) if len(w) >= 3]
    assert [v for _, v in got["now"]] == pytest.approx([reduce([v for u, v in ticks[:i + 1] if u == t]) for i, (t, _) in enumerate(ticks)])


@pytest.mark.parametrize("ddof", [0, 2, 9])
def test_divisors(spark, ddof):
    x = gauge(12)
    got = ran(spark, lambda: add_graph_output("v", stats.var(replayed(x), 5, ddof=ddof)))["v"]
    assert [v for _, v in got] == pytest.approx([spread([v for _, v in x[max(0, i - 4):i + 1]], ddof) for i in range(len(x))])


@node(returns=Outputs(flood="double", ebb="double"))
def tide(level: ts[float], still: float):
    """Levels by whether they rose or fell by more than a little."""
    s = state(last=None)
    was, s.last = s.last, level.value
    if was is not None and abs(level - was) > still:
        output(**{"flood" if level > was else "ebb": level.value})


@node(returns="double")
def clearance(depth: ts[float], draught: ts[float], least: float = 0.0):
    if ticked(depth) and valid(depth, draught):
        return max(least, depth - draught)


@node(returns="long", alarms=("blink",))
def lighthouse(dark: timedelta, light: timedelta):
    """On and off in turns."""
    s = state(flashes=0)
    if starting():
        schedule_alarm("blink", dark, True)
    elif alarm_value("blink"):
        s.flashes += 1
        schedule_alarm("blink", light, False)
        return s.flashes
    else:
        schedule_alarm("blink", dark, True)


@node(returns="string")
def stamped(x: ts[float]):
    return now().strftime("%H:%M:%S")


def test_nodes(spark):
    x, y = gauge(21), gauge(22, 0.2)

    def graph():
        p, q = replayed(x), replayed(y)
        both = tide(p, still=1.0)
        add_graph_output("flood", both.flood)
        add_graph_output("ebb", both.ebb)
        add_graph_output("clear", clearance(p, q, least=0.5))
        add_graph_output("flash", lighthouse(dark=3 * SEC, light=2 * SEC))
        add_graph_output("stamp", stamped(p))

    got = ran(spark, graph)
    moves = [(t, v, v - w) for (t, v), (_, w) in zip(x[1:], x)]
    assert got["flood"] == [(t, v) for t, v, d in moves if d > 1] and got["ebb"] == [(t, v) for t, v, d in moves if d < -1]
    assert got["clear"] == [(t, max(0.5, p - b)) for t, p, _, _, b in together(x, y) if p is not None and b is not None]
    assert got["flash"] == [(3 + 5 * k, k + 1) for k in range((SPAN - 3) // 5 + 1)]
    assert [v for _, v in got["stamp"]] == [f"08:00:{t:02d}" for t, _ in x]


@node(returns="long")
def lock_keeper(boat: ts[int], opened: ts[int]):
    """Sends the next waiting boat whenever the lock has opened, or was never in use."""
    s = state(queue=[], busy=False)
    if ticked(boat):
        s.queue.append(boat.value)
    if ticked(opened):
        s.busy = False
    if s.queue and not s.busy:
        s.busy = True
        return s.queue.pop(0)


@node(alarms=("level",))
def lock(enters: ts[int]) -> ts[int]:
    if ticked(enters):
        schedule_alarm("level", (1 + enters.value % 3) * SEC, enters.value)
    if alarmed("level"):
        return alarm_value("level")


def test_feedback(spark):
    boats = [(t, i) for i, (t, _) in enumerate(gauge(31, 0.4))][:12]
    entered, free = [], 0
    for t, i in boats:
        free = max(free, t)
        entered.append((free, i))
        free += 1 + i % 3

    def graph():
        loop = feedback("long")
        sent = lock_keeper(replayed(boats, "long"), loop.out())
        with pytest.raises(ValueError):
            add_graph_output("early", sent.series)
        through = lock(sent)
        loop.bind(through)
        with pytest.raises(ValueError):
            loop.bind(through)
        add_graph_output("sent", sent.series)
        add_graph_output("through", through.series)
        add_graph_output("hundred", through.series + 100)

    got = ran(spark, graph, 200)
    assert got["sent"] == entered
    assert got["through"] == [(t + 1 + i % 3, i) for t, i in entered] and got["hundred"] == [(t, i + 100) for t, i in got["through"]]


def test_feedback_in_a_node(spark):
    @node(returns=Outputs(n="long"), feedback={"n": "back"})
    def collatz(x: ts[int], back: ts[int]):
        v = back.value if ticked(back) else x.value
        if v != 1:
            output(n=3 * v + 1 if v % 2 else v // 2)

    got = ran(spark, lambda: add_graph_output("n", collatz(replayed([(5, 6)], "long")).n))["n"]
    assert got == [(5, v) for v in (3, 10, 5, 16, 8, 4, 2, 1)]


def test_dynamic_spawns_without_the_first_tick(spark):
    rng = random.Random(41)
    rows = [(t, rng.choice(["north", "south", "west"]), float(rng.randint(1, 9))) for t in range(1, 15)]
    df = spark.createDataFrame([(START + t * SEC, k, v) for t, k, v in rows], "t timestamp, k string, v double").select("t", F.struct("k", "v").alias("kv"))

    def graph():
        out = dynamic(series_of(df, "kv"), lambda s: {"raw": s.ticks, "sum": op.cumulative(s.ticks), "clock": s.timer(4 * SEC), "born": s.const(1), "curve": s.curve("long", [(2 * SEC, 5), (0 * SEC, 3), (2 * SEC, 6), (START, 4)])})
        for name, s in out.items():
            add_graph_output(name, s)

    found = run(graph, starttime=START, endtime=20 * SEC, spark=spark)
    got = {n: [(r.k, (r.t - START).total_seconds(), r.cyc, r.value) for r in df.orderBy("k", "t", "cyc").collect()] for n, df in found.items()}
    keys = sorted({k for _, k, _ in rows})
    own = {k: [(t, v) for t, n, v in rows if n == k] for k in keys}
    assert got["raw"] == [(k, t, 0, v) for k in keys for t, v in own[k][1:]]
    assert got["sum"] == [(k, t, 0, sum(v for _, v in own[k][1:i + 2])) for k in keys for i, (t, _) in enumerate(own[k][1:])]
    assert got["clock"] == [(k, t, 0, True) for k in keys for t in range(own[k][0][0] + 4, 21, 4)]
    assert got["born"] == [(k, own[k][0][0], 1, 1) for k in keys]
    assert got["curve"] == [(k, own[k][0][0] + d, c, v) for k in keys for d, c, v in ((0, 1, 4), (2, 0, 6))]


def test_keyed_replay(spark):
    rng = random.Random(51)
    rows = [(START + t * SEC, rng.choice("xyz"), float(t)) for t in range(1, 12)]

    def graph():
        m = ReplayAdapterManager(rows)
        assert m.subscribe("x") is m.subscribe("x")
        for k in "xyzw":
            add_graph_output(k, m.subscribe(k))

    got = ran(spark, graph)
    assert got == {k: [(v, v) for _, n, v in rows if n == k] for k in "xyzw"}


@pytest.mark.parametrize("keyed", [False, True])
def test_adapter_rows_of_one_time_are_cycles_of_their_own(spark, keyed):
    """In order of `seq`, past rows at the start too."""
    rng = random.Random(52)
    rows = [(START + rng.choice([-2, 0, 3, 3, 5]) * SEC, rng.choice("xy"), i, float(rng.randint(0, 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "time timestamp, key string, seq long, value double")

    def graph():
        m = AdapterManager(df, seq="seq", each=True)
        series = m.all() if keyed else m.subscribe("x")
        add_graph_output("rows", series)
        add_graph_output("n", op.count(series))

    found = run(graph, starttime=START, endtime=SPAN * SEC, spark=spark)
    for name, value in (("rows", lambda i, v: v), ("n", lambda i, v: i + 1)):
        got = found[name].filter("key = 'x'") if keyed else found[name]
        want = sorted((t, i, v) for t, k, i, v in rows if k == "x")
        assert [(r.t, r.value) for r in got.orderBy("t", "cyc").collect()] == [(max(START, t), value(i, v)) for i, (t, _, v) in enumerate(want)]


def test_native_guard(spark):
    with pytest.raises(PythonInPlan):
        run(lambda: add_graph_output("x", tide(replayed([(1, 1.0)]), still=0.0).ebb), starttime=START, endtime=SEC, spark=spark, native=True)
    run(lambda: add_graph_output("x", stats.median(op.count(timer(SEC)), 2)), starttime=START, endtime=SEC, spark=spark, native=True)


def test_steps(spark):
    moving = begin(lambda: add_graph_output("n", op.count(timer(2 * SEC))), starttime=START, endtime=20 * SEC, spark=spark)
    assert moving.outputs()["n"].count() == 0
    assert [sorted(r.value for r in moving.step(to * SEC)["n"].collect()) for to in (3, 8, 8, 100)] == [[1], [2, 3, 4], [], [5, 6, 7, 8, 9, 10]]
    assert moving.outputs()["n"].count() == 10
    with pytest.raises(ValueError):
        moving.step(SEC)


def test_same_source_is_one_shuffle(spark):
    """However many operators, series of one source share its scan and exchange."""
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("v"))

    def graph():
        x = series_of(df, "v", keys=("k",))
        add_graph_output("x", (stats.mean(x, 3) + stats.max(x, 5)) / stats.stddev(x, 4))
        add_graph_output("tied", read_frame(df, "t", ["v"], keys=("k",))["v"] - 1)

    found = run(graph, starttime=datetime(1970, 1, 1), endtime=1000 * SEC, spark=spark)
    for df_ in found.values():
        assert df_._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # a window for each frame of ticks, and none for latest values of series that tick in every row
    assert found["x"]._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3


def test_partitions_do_not_change_results(spark):
    rows = [(START + (i // 2) * SEC, f"k{i % 3}", float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "t timestamp, k string, v double")

    def graph():
        x = series_of(df, "v", keys=("k",), seq="v")
        add_graph_output("x", stats.mean(x, 3) + op.delay(x, SEC))

    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, run(graph, starttime=START, endtime=60 * SEC, spark=spark)["x"].collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and found[0]
