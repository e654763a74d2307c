"""Throughput of an operator and latency of a micro-batch, on this machine."""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import quantiles

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Throughput:
    events: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.events / self.seconds


def throughput(df: DataFrame, events: int, warm: int = 1) -> Throughput:
    """Seconds that df takes to run, after warm-up runs."""
    for _ in range(warm):
        df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return Throughput(events, time.perf_counter() - began)


@dataclass
class Latency:
    """Of micro-batches, in milliseconds."""

    batches: int
    median: float
    p90: float


def micro_batch_latency(spark: SparkSession, rows_per_second: int = 1_000, seconds: float = 5.0) -> Latency:
    """How long batches of a paced source take to run through a projection."""
    q = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select((F.col("value") * 2).alias("v")).writeStream.format("noop").start()
    time.sleep(seconds)
    took = [p["durationMs"]["triggerExecution"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    cuts = quantiles(took, n=10) if len(took) > 1 else [float(took[0])] * 9 if took else [0.0] * 9
    return Latency(len(took), cuts[4], cuts[8])


@dataclass
class Pacing:
    ticks: int
    per_second: float
    kept_up: bool


def producer_benchmark(adapter, ticks: int = 5_000, target_per_second: float | None = None, batch: int = 500) -> Pacing:
    """How fast one thread can push ticks, in batches; paced if there is a target."""
    began = time.perf_counter()
    for a in range(0, ticks, batch):
        adapter.push_all(list(range(a, min(ticks, a + batch))))
        if target_per_second:
            ahead = began + (a + batch) / target_per_second - time.perf_counter()
            if ahead > 0:
                time.sleep(ahead)
    rate = ticks / (time.perf_counter() - began)
    return Pacing(ticks, rate, target_per_second is None or rate >= 0.9 * target_per_second)
