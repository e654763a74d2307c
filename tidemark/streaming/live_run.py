"""A graph of push adapters on the wall clock: one stream of all adapters, one stateful step for the whole graph.

A paced source beside the adapters moves the watermark, so that alarms and timers fire without ticks. Ticks may
reach the executors `late_after` after their stamps; the run ends when the watermark has passed its end.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.node import Circuit
from ..model import Run, micros, utc
from ..shipping import shared_folder
from .stateful import BUCKET, _stream

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def wired_rows(made: Run) -> DataFrame:
    """All adapters as one stream: _k, t and a column for each adapter; of the clock's rows, the time alone."""
    columns = {name: a.kind for name, a in made.adapters.items()}
    clock = made.spark.readStream.format("rate").option("rowsPerSecond", 2).option("numPartitions", 1).load()
    rows = clock.select(F.lit(0).alias("_k"), F.col("timestamp").alias("t"), *(F.lit(None).cast(k).alias(n) for n, k in columns.items()))
    for name, adapter in made.adapters.items():
        own = adapter.out(made.spark)
        rows = rows.unionByName(own.select(F.lit(0).alias("_k"), "t", *((F.col("value") if n == name else F.lit(None)).cast(k).alias(n) for n, k in columns.items())))
    return rows


def run_live(made: Run, late_after: timedelta) -> dict[str, DataFrame]:
    """Runs until the end of the run's span has passed, and gives the outputs as tables of the shared folder."""
    loop, span = made.live, (micros(utc(made.start) - _EPOCH), micros(utc(made.end) - _EPOCH))
    for name, edges in made.outputs.items():
        if any(e.step is None for e in edges):
            raise ValueError(f"{name}: an adapter's own edge is an output only behind an operator")
    steps, names, back = loop.wired({}), list(made.adapters), loop.back
    found = _stream(wired_rows(made), ["_k"], "t", {n: F.col(n) for n in names}, f"{micros(late_after)} microseconds", lambda: Circuit(steps, names, back, *span), {}, loop.columns)
    folder = f"{shared_folder(made.spark)}/tidemark-live-{uuid.uuid4().hex}"
    query = found.drop("_k").writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        for adapter in made.adapters.values():
            adapter.started.set()
        until = utc(made.end) + timedelta(microseconds=BUCKET)
        while not query.lastProgress or _watermark(query.lastProgress) <= until:
            if query.exception() is not None:
                raise query.exception()
            time.sleep(0.1)
        # the batch that saw this watermark may still be at its timers
        batch = query.lastProgress["batchId"]
        while query.lastProgress["batchId"] <= batch:
            time.sleep(0.1)
    finally:
        query.stop()
        for adapter in made.adapters.values():
            adapter.started.clear()
    rows = made.spark.read.schema(found.drop("_k").schema).parquet(f"{folder}/rows").filter(F.col("t") <= F.timestamp_micros(F.lit(span[1])))
    out = {}
    for name, edges in made.outputs.items():
        for e in edges:
            cell = F.col(f"o{e.step}_{e.out}")
            part = rows.filter(cell.isNotNull()).select("t", "cyc", cell.alias("value"))
            out[name] = out[name].unionByName(part) if name in out else part
    return out


def _watermark(progress) -> datetime:
    mark = progress["eventTime"].get("watermark")
    return datetime.fromisoformat(mark.replace("Z", "+00:00")) if mark else _EPOCH
