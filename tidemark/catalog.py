"""Queries over the star-schema and event tables, and the SQL that says the same.

Every query reads its whole tables. Series from `events` are keyed by user, so each one is a scan, a shuffle by
user and windows on it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark as tm

from .functions import stats
from .functions.node import Outputs, alarm_value, alarmed, node, output, schedule_alarm, state, ticked, ts, valid
from .model import ZERO, Frame, Node, Run, Series, current, series_of, utc
from .operators import basic as op
from .operators.dynamic import dynamic
from .operators.feedback import feedback
from .plans.run import run
from .shipping import shared_folder
from .sinks import tables as sink
from .sources import batch as source

SPAN = (datetime(1990, 1, 1), datetime(2060, 1, 1))
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def settled(x, digits: int):
    """x rounded half up, where what is within a millionth of a unit below a half counts as one: sums in another order round alike."""
    unit = 10.0**digits
    moved = x * unit + 0.500001
    # a floor is a long; from 2**52 on doubles are whole, and infinities and NaN have no floor
    return F.when(F.abs(moved) < 2.0**52, F.floor(moved).cast("double")).otherwise(moved) / unit


def _settled_sql(sql: str) -> str:
    """The same for each round(x, digits) of a statement."""
    at = 0
    while (a := sql.find("round(", at)) >= 0:
        depth, comma, b = 1, None, a + 6
        while depth:
            c = sql[b]
            depth += (c == "(") - (c == ")")
            comma = b if c == "," and depth == 1 else comma
            b += 1
        at = a + 6
        if comma is not None:
            digits = int(sql[comma + 1:b - 1])
            sql = f"{sql[:a]}(floor(({sql[a + 6:comma]}) * 1e{digits} + 0.500001) / 1e{digits}){sql[b:]}"
            at = a
    return sql


def query(sql: str | None = None, name: str | None = None, span: tuple[datetime, datetime] = SPAN):
    """Registers a query; its body runs within a run over the span."""

    def made(fn):
        key = name or fn.__name__

        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            token = current.set(Run(spark, utc(span[0]), utc(span[1])))
            try:
                return fn(spark, sf_dir)
            finally:
                current.reset(token)

        call.__name__, call.__doc__ = key, fn.__doc__
        _QUERIES[key] = call
        if sql:
            _SQL[key] = _settled_sql(sql)
        return fn

    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str, keys: tuple[str, ...] = ("user_id",)) -> Frame:
    """Events as a frame: ts is unique, so every event is a cycle."""
    df = table(spark, sf_dir, "events").select(*dict.fromkeys([*keys, "ts", *columns]))
    return Frame(df.select(*keys, F.col("ts").cast("timestamp").alias("t"), F.lit(0).alias("cyc"), *(c for c in columns if c not in keys)), keys, ZERO)


def of_type(frame: Frame, kind: str, value: str = "value") -> Series:
    """The events of one type as a series; series of one frame share its scan and shuffle."""
    return Series(frame, frame.add(F.when(F.col("event_type") == kind, F.struct(F.col(value).alias("v"))), ("type", kind, value)), Node(kind))


def every(frame: Frame, value: str = "value") -> Series:
    s = Series(frame, frame.add(F.struct(F.col(value).alias("v")), ("every", value)), Node("events"))
    frame.dense.add(s.cell)
    return s


def shown(x: Series, round_to: int | None = None, name: str = "value") -> DataFrame:
    """Keys, ts as the tables have it, and the value."""
    v = F.col("value")
    return x.ticks().select(*x.frame.keys, F.col("t").cast("timestamp_ntz").alias("ts"), (settled(v, round_to) if round_to is not None else v).alias(name))


# --- sources -----------------------------------------------------------------------------------------------

_2020 = (datetime(2020, 1, 1), datetime(2020, 1, 2))


@query("SELECT unnest(generate_series(TIMESTAMP '2020-01-01 00:07:00', TIMESTAMP '2020-01-02', INTERVAL 7 MINUTE)) AS ts, true AS value", span=_2020)
def src_timer(spark, d):
    return shown(source.timer(timedelta(minutes=7)))


@query("SELECT TIMESTAMP '2020-01-01' AS ts, 42 AS value", span=_2020)
def src_const(spark, d):
    return shown(source.const(42))


@query("SELECT date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def src_curve_last_wins(spark, d):
    df = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("t"), "value", "event_id")
    return shown(source.curve_from_frame(df, "value", "t", seq="event_id"))


@query("SELECT user_id, ts, value FROM events WHERE value IS NOT NULL")
def src_read_parquet(spark, d):
    return shown(source.read_parquet(f"{d}/events.parquet", "ts", ["value"], keys=("user_id",))["value"])


@query("SELECT user_id, ts, round(value + event_id, 4) AS value FROM events")
def src_read_frame(spark, d):
    """Two columns of one table are two series on one frame."""
    cols = source.read_frame(table(spark, d, "events"), "ts", ["value", "event_id"], keys=("user_id",))
    return shown(cols["value"] + cols["event_id"], 4)


@query("SELECT user_id, date_trunc('hour', ts) AS ts, round(arg_max(value, event_id) + max(event_id), 4) AS value FROM events GROUP BY 1, 2")
def src_read_frame_ties(spark, d):
    """Rows of one time are one tick, the last row's."""
    df = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "value", "event_id", F.col("event_id").alias("seq"))
    cols = source.read_frame(df, "hour", ["value", "event_id"], keys=("user_id",), seq="seq")
    return shown(cols["value"] + cols["event_id"], 4)


@query("SELECT ts, value FROM events WHERE event_type = 'purchase'")
def src_adapter_subscribe(spark, d):
    """Every purchase ticks, several at one time in cycles of their own."""
    return shown(source.AdapterManager(table(spark, d, "events"), "ts", "event_type", "value", seq="event_id", each=True).subscribe("purchase"))


@query("SELECT event_type, date_trunc('day', ts) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def src_adapter_all_keys(spark, d):
    df = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return shown(source.AdapterManager(df, "day", "event_type", "value", seq="event_id").all())


# --- operators ---------------------------------------------------------------------------------------------

#: click and view values of each user, their ticks and latest values.
PAIR = """WITH a AS (SELECT user_id, ts, CASE WHEN event_type = 'click' THEN value END AS c, CASE WHEN event_type = 'view' THEN value END AS v FROM events),
p AS (SELECT *, last_value(c IGNORE NULLS) OVER w AS cc, last_value(v IGNORE NULLS) OVER w AS vv FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
"""
_FIRES = " FROM p WHERE (c IS NOT NULL OR v IS NOT NULL) AND cc IS NOT NULL AND vv IS NOT NULL"


def pair(spark, d) -> tuple[Series, Series]:
    frame = events(spark, d, "event_type", "value")
    return of_type(frame, "click"), of_type(frame, "view")


for _name, _sign, _sql in (("add", "+", "cc + vv"), ("sub", "-", "cc - vv"), ("mul", "*", "round(cc * vv, 6)"), ("div", "/", "round(cc / (vv - 50), 6)"), ("gt", ">", "cc > vv"), ("lt", "<", "cc < vv"), ("ge", ">=", "cc >= vv"), ("le", "<=", "cc <= vv"), ("eq", "==", "cc = vv"), ("ne", "!=", "cc <> vv")):
    _sql = {"add": "round(cc + vv, 6)", "sub": "round(cc - vv, 6)"}.get(_name, _sql)

    def _binary(spark, d, sign=_sign):
        x, y = pair(spark, d)
        out = op.binary(sign, x, y - 50 if sign == "/" else y)
        return shown(out, 6 if sign in "+-*/" else None)

    query(PAIR + f"SELECT user_id, ts, {_sql} AS value" + _FIRES, name=f"op_{_name}")(_binary)


@query(PAIR + "SELECT user_id, ts, c AS value FROM p WHERE c IS NOT NULL AND vv > 50")
def op_filter(spark, d):
    x, y = pair(spark, d)
    return shown(op.filter(y > 50, x))


@query(PAIR + "SELECT user_id, ts, c AS value FROM p WHERE c IS NOT NULL AND vv > 50")
def op_split_true(spark, d):
    x, y = pair(spark, d)
    return shown(op.split(y > 50, x).true)


@query(PAIR + "SELECT user_id, ts, c AS value FROM p WHERE c IS NOT NULL AND vv <= 50")
def op_split_false(spark, d):
    x, y = pair(spark, d)
    return shown(op.split(y > 50, x).false)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), b AS (SELECT min(date_trunc('day', ts)) AS lo, max(ts) AS hi FROM events),
t AS (SELECT user_id, unnest(generate_series(lo + INTERVAL 1 DAY, hi, INTERVAL 1 DAY)) AS ts FROM u, b)
SELECT t.user_id, t.ts, e.value FROM t ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') e ON t.user_id = e.user_id AND t.ts >= e.ts""")
def op_sample(spark, d):
    """Each user's latest click at every midnight: an as-of join as a union and a window."""
    clicks = of_type(events(spark, d, "event_type", "value"), "click")
    ticks = _clock(table(spark, d, "events"), "INTERVAL 1 DAY")
    return shown(op.sample(series_of(ticks, F.lit(True), keys=("user_id",), op="timer"), clicks))


def _clock(all_events: DataFrame, step: str) -> DataFrame:
    """Times at a step from the first day to the last event, for each user."""
    span = all_events.select(F.struct(F.min(F.date_trunc("day", "ts")).cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi"))).scalar()
    every_step = F.expr(step)
    users = all_events.select("user_id").distinct().withColumn("span", span)
    return users.select("user_id", F.explode(F.sequence(F.col("span.lo") + every_step, F.col("span.hi"), every_step)).alias("t"))


@query("""SELECT user_id, ts, arg_min(value, (p, -event_id)) AS value FROM (
SELECT user_id, date_trunc('hour', ts) AS ts, value, event_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS p FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1, 2""")
def op_merge(spark, d):
    """Clicks and views by the hour, clicks first."""
    return shown(op.merge(*hourly(spark, d, ("user_id",), "click", "view")))


def hourly(spark, d, keys: tuple[str, ...], *kinds: str) -> list[Series]:
    """Series of their own frames, times cut to the hour, so that cycles collide."""
    df = table(spark, d, "events").withColumn("t", F.date_trunc("hour", "ts"))
    return [series_of(df.filter(F.col("event_type") == k), "value", keys=keys, seq="event_id", op=k) for k in kinds]


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS ts, arg_max(value, event_id) FILTER (event_type = 'click') AS c, arg_max(value, event_id) FILTER (event_type = 'view') AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
p AS (SELECT *, last_value(c IGNORE NULLS) OVER w AS cc, last_value(v IGNORE NULLS) OVER w AS vv FROM h WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT ts, round(cc + vv, 6) AS value FROM p WHERE cc IS NOT NULL AND vv IS NOT NULL""")
def op_align_hourly(spark, d):
    """Two sources without keys, combined by their latest values."""
    x, y = hourly(spark, d, (), "click", "view")
    return shown(x + y, 6)


@query("SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS value FROM events")
def op_count(spark, d):
    return shown(op.count(every(events(spark, d, "value"))))


@query("SELECT user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) <= 5")
def op_firstn(spark, d):
    return shown(op.firstN(every(events(spark, d, "value")), 5))


@query("SELECT user_id, ts + INTERVAL 1 HOUR AS ts, value FROM events")
def op_delay(spark, d):
    return shown(op.delay(every(events(spark, d, "value")), timedelta(hours=1)))


@query(PAIR + "SELECT user_id, ts, round(sqrt(cc * cc + vv * vv), 6) AS value" + _FIRES)
def op_apply(spark, d):
    return shown(op.apply(lambda a, b: F.sqrt(a * a + b * b), *pair(spark, d)), 6)


@query("SELECT user_id, ts, 3 * n + 1 AS value FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)")
def op_diamond(spark, d):
    """(n + 1) + 2 n: one tick for each of n."""
    n = op.count(every(events(spark, d, "value")))
    return shown((n + 1) + (n * 2))


# --- rolling statistics ------------------------------------------------------------------------------------

_STATS = {"count": "count(value) OVER w::DOUBLE", "sum": "sum(value) OVER w", "mean": "avg(value) OVER w", "min": "min(value) OVER w", "max": "max(value) OVER w", "first": "first_value(value) OVER w",
          "last": "last_value(value) OVER w", "median": "median(value) OVER w"}
_FRAMES = {"ticks": (10, "ROWS 9 PRECEDING"), "time": (timedelta(days=1), "RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW")}
#: Variance from exact integer cents, so that both engines round the same number.
_CENTS = """WITH c AS (SELECT user_id, ts, round(value * 100)::BIGINT AS v FROM events), s AS (SELECT user_id, ts, count(v) OVER w AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts {})),
r AS (SELECT user_id, ts, CASE WHEN n > 1 THEN (n * q - s * s)::DOUBLE / (n * (n - 1)) / 10000 ELSE 0.0 END AS var FROM s) """

for _kind, (_interval, _frame) in _FRAMES.items():
    for _name, _sql in _STATS.items():

        def _rolling(spark, d, name=_name, interval=_interval):
            return shown(getattr(stats, name)(every(events(spark, d, "value")), interval), 4)

        query(f"SELECT user_id, ts, round({_sql.replace('OVER w::DOUBLE', 'OVER w')}{'::DOUBLE' if _name == 'count' else ''}, 4) AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts {_frame})", name=f"stat_{_name}_{_kind}")(_rolling)

    for _name, _sql in (("var", "round(var, 3)"), ("stddev", "round(sqrt(var), 4)")):

        def _spread(spark, d, name=_name, interval=_interval):
            return shown(getattr(stats, name)(every(events(spark, d, "value")), interval), 3 if name == "var" else 4)

        query(_CENTS.format(_frame) + f"SELECT user_id, ts, {_sql} AS value FROM r", name=f"stat_{_name}_{_kind}")(_spread)


@query("SELECT user_id, ts, round(product(value / 100) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING), 6) AS value FROM events")
def stat_prod_ticks(spark, d):
    return shown(stats.prod(every(events(spark, d, "value")) / 100, 3), 6)


@query("SELECT user_id, ts, round(product(value / 100) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS value FROM events")
def stat_prod_time(spark, d):
    return shown(stats.prod(every(events(spark, d, "value")) / 100, timedelta(hours=1)), 6)


@query("SELECT user_id, ts, round(avg(value) OVER w, 4) AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS 9 PRECEDING) QUALIFY count(*) OVER w >= 5")
def stat_min_points(spark, d):
    return shown(stats.mean(every(events(spark, d, "value")), 10, min_data_points=5), 4)


_TIES = """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(arg_max(value, event_id) * 100)::BIGINT AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2),
m AS (SELECT user_id, ts, v, 0 AS cyc FROM h UNION ALL SELECT user_id, ts, 2 * v, 1 FROM h),
s AS (SELECT a.user_id, a.ts, a.cyc, count(b.v) AS n, sum(b.v) AS s, sum(b.v * b.v) AS q, min(b.v) AS lo, max(b.v) AS hi, arg_min(b.v, (b.ts, b.cyc)) AS f, any_value(a.v) AS l, median(b.v) AS m, product(b.v / 10000) AS p
FROM m a JOIN m b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts AND (b.ts < a.ts OR b.cyc <= a.cyc) GROUP BY ALL) """
for _name, _sql in {"count": "n::DOUBLE", "sum": "round(s / 100.0, 2)", "mean": "round(s / n::DOUBLE / 100, 4)", "min": "round(lo / 100.0, 2)", "max": "round(hi / 100.0, 2)", "first": "round(f / 100.0, 2)", "last": "round(l / 100.0, 2)",
                    "median": "round(m / 100.0, 3)", "prod": "round(p, 6)", "var": "round(CASE WHEN n > 1 THEN (n * q - s * s)::DOUBLE / (n * (n - 1)) / 10000 ELSE 0.0 END, 3)",
                    "stddev": "round(CASE WHEN n > 1 THEN sqrt((n * q - s * s)::DOUBLE / (n * (n - 1))) / 100 ELSE 0.0 END, 4)"}.items():

    def _tied(spark, d, name=_name, digits={"count": None, "mean": 4, "stddev": 4, "prod": 6, "median": 3, "var": 3}.get(_name, 2)):
        """A trailing time over a series that ticks twice at each time."""
        (x,) = hourly(spark, d, ("user_id",), "click")
        twice = op.merge(x, op.delay(x * 2, timedelta(0)))
        out = getattr(stats, name)(twice / 100 if name == "prod" else twice, timedelta(hours=12))
        v = F.col("value")
        return out.ticks().select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), "cyc", (v if digits is None else settled(v, digits)).alias("value"))

    query(_TIES + f"SELECT user_id, ts, cyc, {_sql} AS value FROM s", name=f"stat_{_name}_time_ties")(_tied)


# --- derived patterns --------------------------------------------------------------------------------------

@query("SELECT user_id, ts, sum(value::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::DOUBLE AS value FROM events")
def q_running_sum(spark, d):
    frame = events(spark, d, "value")
    frame.df = frame.df.withColumn("value", F.col("value").cast("decimal(28,2)"))
    return shown(op.cumulative(every(frame))).withColumn("value", F.col("value").cast("double"))


_TRADES = """WITH t AS (SELECT l_partkey AS part, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS cash, l_returnflag = 'A' AS buy FROM lineitem) """


def trades(spark, d) -> DataFrame:
    """Line items as trades of a part, numbered within a day so that each is a cycle of its own."""
    from pyspark.sql import Window

    df = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                                            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("cash"), (F.col("l_returnflag") == "A").alias("buy"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("ts", "l_orderkey", "l_linenumber"))
    return df.select("*", F.col("ts").cast("timestamp").alias("t"), n.alias("cyc"))


def _cell(frame: Frame, value, name: str) -> Series:
    s = Series(frame, frame.add(F.struct(value.alias("v"))), Node(name))
    frame.dense.add(s.cell)
    return s


@query(_TRADES + "SELECT part, ts, l_orderkey, l_linenumber, round(sum(cash) OVER w / sum(qty) OVER w, 4) AS vwap FROM t WINDOW w AS (PARTITION BY part ORDER BY ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def q_vwap(spark, d):
    frame = Frame(trades(spark, d), ("part",))
    vwap = op.cumulative(_cell(frame, F.col("cash"), "cash")) / op.cumulative(_cell(frame, F.col("qty"), "qty"))
    return vwap.frame.df.filter(vwap.ticked).select("part", "ts", "l_orderkey", "l_linenumber", settled(vwap.value, 4).alias("vwap"))


@tm.node(returns=tm.Outputs(vwap="double", n="long"))
def vwap(cash: tm.ts[float], qty: tm.ts[float]):
    s = tm.state(cash=0.0, qty=0.0, n=0)
    s.cash, s.qty, s.n = s.cash + cash.value, s.qty + qty.value, s.n + 1
    tm.output(vwap=s.cash / s.qty, n=s.n)


@query(_TRADES + "SELECT part, ts, row_number() OVER w AS n, round(sum(cash) OVER w / sum(qty) OVER w, 4) AS vwap FROM t WINDOW w AS (PARTITION BY part ORDER BY ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def q_vwap_node(spark, d):
    """The same as a node, whose body names the package."""
    frame = Frame(trades(spark, d), ("part",))
    out = vwap(_cell(frame, F.col("cash"), "cash"), _cell(frame, F.col("qty"), "qty"))
    return out.n.frame.df.select("part", F.col("t").cast("timestamp_ntz").alias("ts"), out.n.value.alias("n"), settled(out.vwap.value, 4).alias("vwap"))


@query(_TRADES + """SELECT part, ts, l_orderkey, l_linenumber, round(sum(CASE WHEN buy THEN -cash ELSE cash END) OVER w + price * sum(CASE WHEN buy THEN qty ELSE -qty END) OVER w, 2) AS pnl
FROM t WINDOW w AS (PARTITION BY part ORDER BY ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)""")
def q_trade_pnl(spark, d):
    """Cash from sells and buys, and the position marked to the last price."""
    frame = Frame(trades(spark, d), ("part",))
    sign = F.when(F.col("buy"), F.lit(1.0)).otherwise(F.lit(-1.0))
    cash, position, price = (_cell(frame, v, n) for v, n in ((-sign * F.col("cash"), "cash"), (sign * F.col("qty"), "position"), (F.col("price"), "price")))
    pnl = op.cumulative(cash) + price * op.cumulative(position)
    return pnl.frame.df.filter(pnl.ticked).select("part", "ts", "l_orderkey", "l_linenumber", settled(pnl.value, 2).alias("pnl"))


@query("SELECT user_id, event_type, round(avg(value), 4) AS mean, max(ts) AS ts FROM events GROUP BY 1, 2")
def q_group_mean_last(spark, d):
    """What the running means have come to: the last one of each key, which is a partial aggregation, not a window."""
    df = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.max("ts").alias("ts"))
    return df.select("user_id", "event_type", settled(F.col("mean"), 4).alias("mean"), "ts")


@query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_tumbling_day(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    df = table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return df.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", settled(F.col("total"), 4).alias("total"))


@query("SELECT user_id, ts, round((value - p) / p, 6) AS value FROM (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NOT NULL AND p <> 0")
def q_pct_change(spark, d):
    frame = events(spark, d, "value")
    x = every(frame)
    last = x.frame.before(x.cell).getField("v")
    return shown(x.derive("pct_change", last.isNotNull() & (last != 0), F.try_divide(x.value - last, last)), 6)


@query(_CENTS.format("ROWS 19 PRECEDING").replace("r AS (SELECT user_id, ts,", "r AS (SELECT user_id, ts, s / n::DOUBLE / 100 AS mean,") + "SELECT user_id, ts, round(mean, 4) AS middle, round(mean - 2 * sqrt(var), 4) AS lower, round(mean + 2 * sqrt(var), 4) AS upper FROM r")
def q_bollinger(spark, d):
    """Bands of two deviations around the mean of 20 ticks."""
    x = every(events(spark, d, "value"))
    mean, dev = stats.mean(x, 20), stats.stddev(x, 20)
    low, high = mean - dev * 2, mean + dev * 2
    return high.frame.df.filter(high.ticked).select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), settled(mean.value, 4).alias("middle"), settled(low.value, 4).alias("lower"), settled(high.value, 4).alias("upper"))


@query(_CENTS.format("ROWS 9 PRECEDING") + "SELECT user_id, ts, round(s / n::DOUBLE / 100, 4) AS mean, round(sqrt((n * q - s * s)::DOUBLE / (n * n)) / 100, 4) AS dev FROM s")
def q_rolling_population_std(spark, d):
    x = every(events(spark, d, "value"))
    mean, dev = stats.mean(x, 10), stats.stddev(x, 10, ddof=0)
    return dev.frame.df.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), settled(mean.value, 4).alias("mean"), settled(dev.value, 4).alias("dev"))


@query(PAIR + "SELECT user_id, ts, round((cc + vv) / 2, 6) AS mid, round(vv - cc, 6) AS spread, vv - cc > 10 AS wide" + _FIRES)
def q_mid_spread(spark, d):
    bid, ask = pair(spark, d)
    mid, spread = (bid + ask) / 2, ask - bid
    wide = spread > 10
    return wide.frame.df.filter(wide.ticked).select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), settled(mid.value, 6).alias("mid"), settled(spread.value, 6).alias("spread"), wide.value.alias("wide"))


@query("SELECT user_id, ts, round(avg((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS value FROM events")
def q_ratio(spark, d):
    frame = events(spark, d, "event_type")
    return shown(op.cumulative(_cell(frame, (F.col("event_type") == "error").cast("double"), "error"), "mean"), 6)


@query("SELECT user_id, event_type, ts, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS value FROM events")
def q_group_mean(spark, d):
    """Running mean of each user and event type."""
    return shown(op.cumulative(every(events(spark, d, "value", keys=("user_id", "event_type"))), "mean"), 4)


@query("""WITH n AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n, min(ts) OVER (PARTITION BY user_id, event_type) AS f FROM events)
SELECT user_id, ts, arg_max(event_type, (n, -epoch_us(f))) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS leader FROM n""")
def q_leader(spark, d):
    """The most frequent event type so far; of equals the one seen first. Counts come from windows by type, the leader from one by user."""
    from pyspark.sql import Window

    df = events(spark, d, "event_type").df
    w = Window.partitionBy("user_id", "event_type").orderBy("t")
    n = df.select("user_id", "t", "event_type", F.row_number().over(w).alias("n"), F.first("t").over(w).alias("f"))
    best = F.max_by("event_type", F.struct("n", -F.unix_micros("f"))).over(Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), best.alias("leader"))


@query("SELECT user_id, ts, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE value > coalesce(m, -1)")
def q_argmax_record(spark, d):
    from pyspark.sql import Window

    frame = events(spark, d, "value")
    x = every(frame)
    m = F.col(frame.add(F.max("value").over(frame.order.rowsBetween(Window.unboundedPreceding, -1))))
    return shown(x.derive("record", x.value > F.coalesce(m, F.lit(-1.0)), x.value))


@query("""WITH e AS (SELECT user_id, ts, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)), b AS (SELECT min(date_trunc('day', ts)) AS lo, max(ts) AS hi FROM events),
t AS (SELECT user_id, unnest(generate_series(lo + INTERVAL 12 HOUR, hi, INTERVAL 12 HOUR)) AS ts FROM (SELECT DISTINCT user_id FROM events), b)
SELECT t.user_id, t.ts, e.n::DOUBLE AS value FROM t ASOF JOIN e ON t.user_id = e.user_id AND t.ts >= e.ts""")
def q_windowed_rate_sampled(spark, d):
    """Events in the last six hours as of each event, sampled twice a day."""
    rate = stats.count(every(events(spark, d, "value")), timedelta(hours=6))
    ticks = _clock(table(spark, d, "events"), "INTERVAL 12 HOUR")
    return shown(op.sample(series_of(ticks, F.lit(True), keys=("user_id",), op="timer"), rate))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, round(l_quantity * p_retailprice, 4) AS notional FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def q_enrich(spark, d):
    """Lookup in a reference table; Spark broadcasts it where its size allows and merges otherwise."""
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return df.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", settled(F.col("l_quantity") * F.col("p_retailprice"), 4).alias("notional"))


@query("""WITH o AS (SELECT user_id, ts, event_id, value, coalesce(lag(value) OVER u, first_value(value) OVER u) AS p, first_value(value) OVER u AS open FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT ts, round(1 + sum((value - p) / open / n) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS value FROM o, k WHERE open <> 0""")
def q_index_fold(spark, d):
    """An equal-weight index over users, moved by each event: changes by user, then one running sum over time.

    The sum has no key: each hour's total comes first, then each hour adds what lies before it.
    """
    frame = events(spark, d, "value")
    x = every(frame)
    moved = x.value - F.coalesce(frame.before(x.cell).getField("v"), x.value)
    df = frame.df.select("t", "cyc", (moved / F.first("value").over(frame.so_far)).alias("x"), F.first("value").over(frame.so_far).alias("open")).filter("open != 0").select("t", "cyc", "x")
    steps = Frame(df, (), ZERO)
    total = op.cumulative(_cell(steps, F.col("x"), "steps"), split=timedelta(hours=1))
    users = table(spark, d, "events").select(F.countDistinct("user_id")).scalar()
    return shown(total.derive("index", None, 1 + total.value / users), 6)


@node(returns=Outputs(position="long", price="double"))
def positioned(x: ts[float], low: float, high: float):
    """A position that signals move by one, and the price it stands at."""
    s = state(position=0)
    s.position = max(-1, min(1, s.position + (x.value > high) - (x.value < low)))
    output(position=s.position, price=x.value)


_POSITION = """WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT user_id, n, ts, value, (value > 70)::INT - (value < 30)::INT AS position FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.ts, e.value, greatest(-1, least(1, f.position + (e.value > 70)::INT - (e.value < 30)::INT)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
"""


@query(_POSITION + """, d AS (SELECT *, position - coalesce(lag(position) OVER (PARTITION BY user_id ORDER BY n), 0) AS moved FROM f),
c AS (SELECT *, sum(-moved * value) OVER w AS cash, sum((moved <> 0)::BIGINT) OVER w AS trades FROM d WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT user_id, ts, position::BIGINT AS position, round(cash, 4) AS cash, round(cash + position * value, 4) AS pnl, trades::BIGINT AS trades FROM c""")
def q_position_pnl(spark, d):
    """Position by a fold; its cash, its worth at the last price and its trades as running sums of columns."""
    out = positioned(every(events(spark, d, "value")), low=30.0, high=70.0)
    frame = out.position.frame
    moved = F.col(frame.add(out.position.value - F.coalesce(frame.before(out.position.cell).getField("v"), F.lit(0))))
    cash, trades = op.cumulative(_cell(frame, -moved * out.price.value, "cash")), op.cumulative(_cell(frame, (moved != 0).cast("long"), "trades"))
    pnl = cash.value + out.position.value * out.price.value
    return frame.df.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), out.position.value.alias("position"), settled(cash.value, 4).alias("cash"), settled(pnl, 4).alias("pnl"), trades.value.alias("trades"))


@node(returns=Outputs(position="long", traded="boolean"))
def hysteresis(x: ts[float], low: float, high: float):
    """A position that a high value raises and a low one lowers, between -1 and 1."""
    s = state(position=0)
    was = s.position
    if x.value > high:
        s.position = min(1, s.position + 1)
    elif x.value < low:
        s.position = max(-1, s.position - 1)
    output(position=s.position, traded=s.position != was)


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT user_id, n, ts, (value > 70)::INT - (value < 30)::INT AS position FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.ts, greatest(-1, least(1, f.position + (value > 70)::INT - (value < 30)::INT)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, ts, position::BIGINT AS position, position <> coalesce(lag(position) OVER (PARTITION BY user_id ORDER BY n), 0) AS traded FROM f""")
def q_position_hysteresis(spark, d):
    out = hysteresis(every(events(spark, d, "value")), low=30.0, high=70.0)
    return out.position.frame.df.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), out.position.value.alias("position"), out.traded.value.alias("traded"))


_STA = """WITH s AS (SELECT user_id, ts, row_number() OVER u AS n, avg(value) OVER (u ROWS 2 PRECEDING) AS sta, avg(value) OVER (u ROWS 19 PRECEDING) AS lta FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)) """


def _sta_lta(spark, d) -> Series:
    x = every(events(spark, d, "value"))
    return stats.mean(x, 3) / stats.mean(x, 20, min_data_points=20)


@query(_STA + "SELECT user_id, ts, round(sta / lta, 6) AS value FROM s WHERE n >= 20")
def q_sta_lta(spark, d):
    return shown(_sta_lta(spark, d), 6)


@node(returns="double")
def spaced(ratio: ts[float], at: ts[int], gap: int):
    """Crossings that are more than `gap` ticks after the last one that fired."""
    s = state(last=None)
    if s.last is None or at.value - s.last > gap:
        s.last = at.value
        return ratio.value


@query("""WITH RECURSIVE """ + _STA.replace("WITH s", "s") + """, r AS (SELECT user_id, ts, sta / lta AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s WHERE n >= 20),
c AS (SELECT *, ratio > 1.3 AND NOT coalesce(lag(ratio) OVER (PARTITION BY user_id ORDER BY n) > 1.3, false) AS crosses FROM r),
k AS (SELECT user_id, ts, ratio, n, row_number() OVER (PARTITION BY user_id ORDER BY n) AS i FROM c WHERE crosses),
f AS (SELECT user_id, i, ts, ratio, n AS fired, true AS fires FROM k WHERE i = 1
UNION ALL SELECT k.user_id, k.i, k.ts, k.ratio, CASE WHEN k.n - f.fired > 10 THEN k.n ELSE f.fired END, k.n - f.fired > 10 FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1)
SELECT user_id, ts, round(ratio, 6) AS value FROM f WHERE fires""")
def q_trigger_refractory(spark, d):
    """Rising edges are found in columns; only they go to the fold."""
    ratio = _sta_lta(spark, d)
    frame = ratio.frame
    last = frame.before(ratio.cell).getField("v")
    n = F.col(frame.add(F.count(ratio.cell).over(frame.so_far)))
    rises = ratio.ticked & (ratio.value > 1.3) & ~F.coalesce(last > 1.3, F.lit(False))
    edge = ratio.derive("rise", rises, ratio.value)
    return shown(spaced(edge, edge.derive("at", rises, n), gap=10), 6)


@query("SELECT user_id, ts, n AS value FROM (SELECT user_id, unnest(generate_series(min(ts) + INTERVAL 36 HOUR, min(ts) + INTERVAL 30 DAY, INTERVAL 36 HOUR)) AS ts, unnest(generate_series(1, 20)) AS n FROM events GROUP BY 1)")
def q_heartbeat(spark, d):
    """A beat every 36 hours from each user's first event, 20 times: an alarm that sets itself."""
    first = op.firstN(every(events(spark, d, "value")), 1)
    return shown(beats(first, period=timedelta(hours=36), times=20))


@node(returns="long")
def beats(x: ts[float], period: timedelta, times: int):
    s = state(n=0)
    if ticked(x):
        schedule_alarm("beat", period)
    elif s.n < times:
        s.n += 1
        if s.n < times:
            schedule_alarm("beat", period)
        return s.n


@node(returns=Outputs(order="long", report="long"), feedback={"report": "ack"}, alarms=("send", "exec"))
def order_loop(x: ts[float], ack: ts[int], send: timedelta, execute: timedelta, orders: int):
    """Sends an order, executes it later, and sends the next once its report came back."""
    s = state(n=0)
    if ticked(x):
        schedule_alarm("send", send)
    if ticked(ack) and s.n < orders:
        schedule_alarm("send", send)
    if alarmed("send"):
        s.n += 1
        output(order=s.n)
        schedule_alarm("exec", execute, s.n)
    if alarmed("exec"):
        output(report=s.n)


@query("SELECT user_id, min(ts) + (n - 1) * INTERVAL 1700 SECOND + INTERVAL 1000 SECOND AS ts, n AS value FROM events, generate_series(1, 3) g(n) GROUP BY user_id, n")
def q_feedback_orders(spark, d):
    """Three orders for each user, each sent after the one before was reported: a loop through a feedback edge."""
    first = op.firstN(every(events(spark, d, "value")), 1)
    return shown(order_loop(first, send=timedelta(seconds=1000), execute=timedelta(seconds=700), orders=3).order)


@node(returns="long")
def asks(x: ts[float], granted: ts[int], times: int):
    """The number of a request, one more whenever the last was granted."""
    if ticked(x):
        return 1
    if granted.value < times:
        return granted.value + 1


@node(returns="long", alarms=("grant",))
def grants(asked: ts[int], wait: timedelta):
    """Grants a request after its number of waits."""
    if ticked(asked):
        schedule_alarm("grant", asked.value * wait, asked.value)
    if alarmed("grant"):
        return alarm_value("grant")


@query("SELECT user_id, min(ts) + (n * (n + 1) // 2) * INTERVAL 100 SECOND AS ts, n AS value FROM events, generate_series(1, 4) g(n) GROUP BY user_id, n")
def q_feedback_edges(spark, d):
    """Two nodes on a feedback edge: each grant comes back to the asking node in the next cycle."""
    loop = feedback("long")
    asked = asks(op.firstN(every(events(spark, d, "value")), 1), loop.out(), times=4)
    granted = grants(asked, wait=timedelta(seconds=100))
    loop.bind(granted)
    return shown(granted.series)


@query("SELECT user_id, ts, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING), 4) AS value FROM events")
def q_run(spark, d):
    """A graph function given to a run."""
    def graph(rows):
        tm.add_graph_output("mean", tm.stats.mean(tm.read_frame(rows, "ts", ["value"], keys=("user_id",))["value"], 5))

    found = run(graph, table(spark, d, "events"), starttime=SPAN[0], endtime=SPAN[1], spark=spark)["mean"]
    return found.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), settled(F.col("value"), 4).alias("value"))


@query("SELECT user_id, ts, c <> v AS x, (c AND v) AS carry FROM (SELECT user_id, ts, (k % 2 = 1) AS c, (k // 2 % 2 = 1) AS v FROM (SELECT user_id, ts, json_extract(props, '$.k')::BIGINT AS k FROM events))")
def q_nand_circuit(spark, d):
    """A half adder of NAND gates alone."""
    frame = events(spark, d, "props")
    k = F.get_json_object("props", "$.k").cast("long")
    a, b = _cell(frame, k % 2 == 1, "a"), _cell(frame, F.floor(k / 2) % 2 == 1, "b")

    def nand(x, y):
        return op.apply(lambda p, q: ~(p & q), x, y, total=True)

    n = nand(a, b)
    x, carry = nand(nand(a, n), nand(b, n)), nand(n, n)
    return frame.df.select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), x.value.alias("x"), carry.value.alias("carry"))


@query("SELECT user_id, ts, json_extract(props, '$.k')::BIGINT AS value FROM events")
def json_field(spark, d):
    frame = events(spark, d, "props")
    return shown(op.apply(lambda p: F.get_json_object(p, "$.k").cast("long"), every(frame, "props")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS value FROM embeddings")
def array_value(spark, d):
    """An array on an edge, folded without leaving the JVM."""
    return table(spark, d, "embeddings").select("vec_id", settled(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("value"))


# --- dynamic graphs ----------------------------------------------------------------------------------------

@query("SELECT event_type, ts, (sum(value::DECIMAL(18, 2)) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) - first_value(value::DECIMAL(18, 2)) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING))::DOUBLE AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) > 1")
def dyn_spawn_sum(spark, d):
    """Running sums of keys as they appear, each without the tick that spawned it."""
    df = table(spark, d, "events").select("ts", F.struct(F.col("event_type").alias("k"), F.col("value").cast("decimal(18,2)").alias("v")).alias("kv"))
    out = dynamic(series_of(df, "kv", t="ts"), lambda s: op.cumulative(s.ticks, split=timedelta(hours=1)))["out"]
    return shown(out).select(F.col("k").alias("event_type"), "ts", F.col("value").cast("double").alias("value"))


@query("SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) > 1")
def dyn_bare_count(spark, d):
    out = dynamic(series_of(table(spark, d, "events"), "user_id", t="ts"), lambda s: op.count(s.ticks), key="user_id", value=None)["out"]
    return shown(out)


@query("SELECT event_type, ts, 1 AS value FROM (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1)")
def dyn_const(spark, d):
    """A constant of each spawned graph ticks at spawn time."""
    return shown(_spawned(spark, d, lambda s: s.const(1))).withColumnRenamed("k", "event_type")


@query("SELECT event_type, unnest(generate_series(ts + INTERVAL 1 DAY, ts + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS ts, true AS value FROM (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1)", span=(datetime(1990, 1, 1), datetime(2060, 1, 1)))
def dyn_timer(spark, d):
    """A timer of each spawned graph counts from its spawn time; the first twenty days."""
    return shown(op.firstN(_spawned(spark, d, lambda s: s.timer(timedelta(days=1))), 20)).withColumnRenamed("k", "event_type")


@query("SELECT event_type, ts + h * INTERVAL 1 HOUR AS ts, v AS value FROM (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1), (VALUES (0, 10), (1, 1), (2, 3)) p(h, v)")
def dyn_curve(spark, d):
    """A curve of each spawned graph counts from its spawn time; of two points at one time the last stays."""
    hour = timedelta(hours=1)
    return shown(_spawned(spark, d, lambda s: s.curve("int", [(0 * hour, 10), (2 * hour, 2), (hour, 1), (2 * hour, 3)]))).withColumnRenamed("k", "event_type")


def _spawned(spark, d, factory) -> Series:
    df = table(spark, d, "events").select("ts", F.struct(F.col("event_type").alias("k"), F.col("value").alias("v")).alias("kv"))
    return dynamic(series_of(df, "kv", t="ts"), factory)["out"]


# --- sinks -------------------------------------------------------------------------------------------------

def _two_outputs(spark, d) -> dict[str, DataFrame]:
    x, y = hourly(spark, d, ("user_id",), "click", "view")
    return {"click": x.ticks(), "view": y.ticks()}


_HOURS = "SELECT user_id, date_trunc('hour', ts) AS time, event_type AS name, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3"


@query(_HOURS)
def sink_long(spark, d):
    return sink.to_long(_two_outputs(spark, d)).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"SELECT user_id, time, max(value) FILTER (name = 'click') AS click, max(value) FILTER (name = 'view') AS view FROM ({_HOURS}) GROUP BY 1, 2")
def sink_wide(spark, d):
    return sink.to_wide(_two_outputs(spark, d)).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), t AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS time, n, value FROM c)
SELECT time, 'count' AS node, n::VARCHAR AS value FROM t UNION ALL SELECT time, '*', (n * 2)::VARCHAR FROM t UNION ALL SELECT time, 'parity[0]', n::VARCHAR FROM t WHERE n % 2 = 0 UNION ALL SELECT time, 'parity[1]', n::VARCHAR FROM t WHERE n % 2 = 1""")
def sink_audit(spark, d):
    """Every tick of every step as text, the outputs of one node told apart."""
    from .plans.run import distinct

    n = op.count(every(events(spark, d, "value")))
    twice, out = n * 2, parity(n)
    return sink.audit(distinct([n, twice, out.even, out.odd])).withColumn("node", F.regexp_replace("node", "#[0-9]+", ""))


@node(returns=Outputs(even="long", odd="long"))
def parity(n: ts[int]):
    output(**{"odd" if n.value % 2 else "even": n.value})


# --- streams -----------------------------------------------------------------------------------------------

@node(returns=Outputs(n="long", total="double"))
def running(x: ts[float]):
    """Ticks so far and their sum."""
    s = state(n=0, total=0.0)
    s.n, s.total = s.n + 1, s.total + x.value
    output(n=s.n, total=s.total)


@node(returns="double")
def sampled(trigger: ts[float], x: ts[float]):
    """x's latest value on each tick of the trigger."""
    if ticked(trigger) and valid(x):
        return x.value


def _streamed(spark, d, name: str, made) -> DataFrame:
    """`made` of `events` as a stream: the table's file, then a file of one far row that lets the last rows through."""
    import uuid

    from .streaming.stateful import FAR, replay, run_available

    schema = table(spark, d, "events").schema
    folder = f"{shared_folder(spark)}/tidemark-far-{uuid.uuid4().hex}"
    far = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(FAR).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"))
    far.write.parquet(folder)
    # both in the first batch; the batch without data that follows fires the timers
    stream = replay(spark, d, "events.parquet", schema).select("user_id", "ts", "event_type", "value").unionByName(replay(spark, folder, "*.parquet", far.schema))
    found = run_available(made(stream), name)
    return found.filter("user_id >= 0").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t", "cyc")


@query("SELECT user_id, ts, row_number() OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def stream_equals_batch_running(spark, d):
    from .streaming.stateful import stream_node

    out = _streamed(spark, d, "running", lambda s: stream_node(running, s, ["user_id"], "ts", {"x": F.col("value")}, "0 seconds"))
    return out.select("user_id", "ts", "n", settled(F.col("total"), 4).alias("total"))


@query("SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events WHERE event_type IN ('click', 'view'))")
def stream_equals_batch_merge_ties(spark, d):
    """Clicks and views cut to the hour: rows of one time are one cycle, on streams too."""
    from .streaming.stateful import stream_graph

    def graph(click, view):
        return {"n": op.count(op.merge(click, view))}

    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    hours = lambda s: s.withColumn("ts", F.when(F.col("user_id") >= 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts").cast("timestamp")))
    return _streamed(spark, d, "ties", lambda s: stream_graph(graph, hours(s), ["user_id"], "ts", {"click": of("click"), "view": of("view")}, "0 seconds")).select("user_id", "ts", "n")


@query("""WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM events)
SELECT user_id, ts, c AS value FROM p WHERE event_type = 'view' AND c IS NOT NULL""")
def stream_equals_batch_sample(spark, d):
    from .streaming.stateful import stream_node

    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    out = _streamed(spark, d, "sampled", lambda s: stream_node(sampled, s, ["user_id"], "ts", {"trigger": of("view"), "x": of("click")}, "0 seconds"))
    return out.select("user_id", "ts", F.col("out").alias("value"))


@query("""WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, ts, c + v AS value FROM p WHERE event_type IN ('click', 'view') AND c IS NOT NULL AND v IS NOT NULL),
m AS (SELECT user_id, ts, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING) AS mean FROM s)
SELECT user_id, ts, round(mean, 4) AS mean, CASE WHEN value > 100 THEN round(value, 4) END AS large FROM m""")
def stream_equals_batch_graph(spark, d):
    """A graph of several operators as one stateful step."""
    from .streaming.stateful import stream_graph

    def graph(click, view):
        total = click + view
        return {"mean": stats.mean(total, 5), "large": op.filter(total > 100, total)}

    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    out = _streamed(spark, d, "graph", lambda s: stream_graph(graph, s, ["user_id"], "ts", {"click": of("click"), "view": of("view")}, "0 seconds"))
    return out.select("user_id", "ts", settled(F.col("mean"), 4).alias("mean"), settled(F.col("large"), 4).alias("large"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
