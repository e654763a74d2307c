"""Live bodies give what the batch operators give."""

from datetime import datetime, timedelta

import pytest

from tidemark.functions import stats
from tidemark.model import series_of
from tidemark.operators import basic as op
from tidemark.plans.benchmarks import micro_batch_latency, producer_benchmark, throughput
from tidemark.plans.run import run
from tidemark.sinks.tables import add_graph_output
from tidemark.streaming import operators as live
from tidemark.streaming.live import GenericPushAdapter

START, SEC = datetime(2020, 1, 1), timedelta(seconds=1)
EPOCH = datetime(1970, 1, 1)
X = [(1, 5.0), (2, -1.0), (4, 3.0), (5, 8.0), (7, 2.5)]
Y = [(2, 10.0), (3, 0.0), (5, -4.0)]


def us(seconds):
    return (START - EPOCH) // timedelta(microseconds=1) + int(seconds * 1_000_000)


def folded(body, **scalars):
    fold, out = body.folding(end_us=us(100), **scalars), []
    cells = {t: [None, None] for t, _ in X + Y}
    for k, data in enumerate((X, Y)):
        for t, v in data:
            cells[t][k] = (v,)
    n = len(body.inputs)
    for t in sorted(cells):
        row = cells[t][::-1] if body.inputs[0] in ("flag", "trigger") else cells[t]
        if any(c is not None for c in row[:n]):
            out += fold.feed(us(t), 0, row[:n])
    return [((t - us(0)) / 1e6, *(None if c is None else c[0] for c in x)) for t, _, x in [*out, *fold.due()]]


def batch(spark, build):
    frames = [spark.createDataFrame([(START + t * SEC, v) for t, v in d], "t timestamp, v double") for d in (X, Y)]

    def graph():
        add_graph_output("out", build(*(series_of(f, "v") for f in frames)))

    rows = run(graph, starttime=START, endtime=100 * SEC, spark=spark)["out"].orderBy("t", "cyc").collect()
    return [((r.t - START).total_seconds(), r.value) for r in rows]


@pytest.mark.parametrize("body,scalars,build", [
    (live.count, {}, lambda x, y: op.count(x)), (live.first_n, {"n": 2}, lambda x, y: op.firstN(x, 2)), (live.gate, {}, lambda x, y: op.filter(y, x)), (live.sample, {}, lambda x, y: op.sample(y, x)),
    (live.merge, {}, lambda x, y: op.merge(x, y)), (live.delay, {"by": 1.5 * SEC}, lambda x, y: op.delay(x, 1.5 * SEC)), *((live.binary, {"op": s}, lambda x, y, s=s: op.binary(s, x, y)) for s in "+-*/"),
    *((live.rolling, {"stat": s, "interval": i}, lambda x, y, s=s, i=i: getattr(stats, s)(x, i)) for s in ("count", "sum", "mean", "min", "max", "first", "last", "prod", "median", "var", "stddev") for i in (3, 2 * SEC)),
    (live.rolling, {"stat": "mean", "interval": 3, "min_data_points": 3}, lambda x, y: stats.mean(x, 3, min_data_points=3)),
])
def test_live_is_batch(spark, body, scalars, build):
    got, want = folded(body, **scalars), batch(spark, build)
    assert [t for t, _ in got] == [t for t, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])


def test_live_split(spark):
    got = folded(live.split)
    assert [(t, a) for t, a, _ in got if a is not None] == batch(spark, lambda x, y: op.split(y, x).true)
    assert [(t, b) for t, _, b in got if b is not None] == batch(spark, lambda x, y: op.split(y, x).false)


def test_benchmarks(spark, tmp_path):
    assert throughput(spark.range(1000).selectExpr("id * 2"), 1000).per_second > 0
    assert producer_benchmark(GenericPushAdapter("long", f"{tmp_path}/p"), 2_000).per_second > 1_000
    assert micro_batch_latency(spark, 100, 4.0).batches >= 0
