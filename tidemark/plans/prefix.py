"""Running totals of few keys, or none, without a task that holds a key's rows.

Time is cut into periods. Each period's total is summed first, and there are only as many rows as periods; a row's
running total is that within its period plus the totals of the periods before.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros


def running_total(df: DataFrame, keys: tuple[str, ...], value: str, period: timedelta, name: str = "total") -> DataFrame:
    """df (keys, t, cyc and others) with a running sum of `value` by t and cyc for each key; rows are in as many tasks as periods."""
    own = [*keys, "_period"]
    # both sides read all columns of one exchange, so that it and what lies before it run once
    dealt = df.withColumn("_period", F.floor(F.unix_micros("t") / micros(period))).repartition(*own)
    totals = dealt.groupBy(*own).agg(F.sum(value).alias("_sum"), F.max(F.struct(*df.columns)).alias("_all"))
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_sum").over(earlier.orderBy("_period").rowsBetween(Window.unboundedPreceding, -1))
    known = totals.filter(F.col("_all").isNotNull()).select(*own, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*own).orderBy("t", "cyc").rowsBetween(Window.unboundedPreceding, 0))
    same = F.lit(True)
    for k in own:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = dealt.withColumn("_within", within).alias("a").join(known.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("b._before") + F.col("a._within")).alias(name))
