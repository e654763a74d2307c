"""Results as tables: long, wide, files, prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Series, running


def add_graph_output(name: str, x: Series) -> None:
    """Names an output; a name used twice collects the ticks of both."""
    run = running()
    run.outputs.setdefault(name, []).append(x.series if hasattr(x, "loop") and run.live is None else x)


def format_time(t: Column | str) -> Column:
    """A time as seconds.nanoseconds."""
    return F.format_string("%d.%06d000", F.unix_seconds(t), F.unix_micros(t) % 1_000_000)


def print_node(name: str, x: Series) -> None:
    """Ticks as text lines when the run ends: seconds.nanoseconds, name, value. For small results."""
    df = x.ticks().orderBy("t", "cyc").select(F.concat_ws(" ", format_time("t"), F.lit(name), F.coalesce(F.col("value").cast("string"), F.lit("null"))))

    def show():
        for row in df.toLocalIterator():
            print(row[0])

    running().on_stop.append(show)


def to_long(result: dict[str, DataFrame]) -> DataFrame:
    """time, name, value of all outputs (and key columns, if any)."""
    out = None
    for name, df in result.items():
        keys = [c for c in df.columns if c not in ("t", "cyc", "value")]
        part = df.select(*keys, F.col("t").alias("time"), F.lit(name).alias("name"), F.col("value"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def to_wide(result: dict[str, DataFrame]) -> DataFrame:
    """A row for each key and time, a column for each output; one aggregation, no join. Of a time's cycles the last counts."""
    names, out = list(result), None
    for name, df in result.items():
        keys = [c for c in df.columns if c not in ("t", "cyc", "value")]
        kinds = {n: result[n].schema["value"].dataType for n in names}
        part = df.select(*keys, F.col("t").alias("time"), "cyc", *(F.struct(F.col("value").alias("v")).alias(n) if n == name else F.lit(None).cast(f"struct<v:{kinds[n].simpleString()}>").alias(n) for n in names))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "time").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("cyc"))).getField("v").alias(n) for n in names))


def wide_of(edges: dict[str, Series]) -> DataFrame:
    return to_wide({k: s.ticks() for k, s in edges.items()})


def write_parquet(path: str, **edges: Series) -> None:
    """The wide table, written when the run ends."""
    df = wide_of(edges)
    running().on_stop.append(lambda: df.write.mode("overwrite").parquet(path))


def write_csv(path: str, **edges: Series) -> None:
    df = wide_of(edges)
    running().on_stop.append(lambda: df.write.mode("overwrite").option("header", True).csv(path))


def schedule_on_engine_stop(callback) -> None:
    """Called after the run; an exception in one doesn't stop the others."""
    running().on_stop.append(callback)


def audit(series: list[Series]) -> DataFrame:
    """Every tick of every producer: time, node (name#number, and [k] for output k of several), value, all as text."""
    out = None
    for s in series:
        label = f"{s.node.op}#{s.node.id}" + ("" if s.out is None else f"[{s.out}]")
        part = s.ticks().select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.lit(label).alias("node"), F.col("value").cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["add_graph_output", "audit", "format_time", "print_node", "schedule_on_engine_stop", "to_long", "to_wide", "wide_of", "write_csv", "write_parquet"]
