"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a written table, so lineage stays short; a node's neighbours are never gathered, only their minimum,
which is summed before the shuffle, and given back to them. A hub may have a third of all edges: `with_group` gives
large groups their value by a broadcast of `MOST_HEAVY` rows at most, so that only small groups are shuffled by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, discard, written

#: A group is heavy from so many rows on, and from a share of all rows by which there are at most `MOST_HEAVY` such groups.
LEAST_HEAVY, MOST_HEAVY = 10_000, 10_000


def with_group(rows: DataFrame, key: str, total: int, **values: Column) -> DataFrame:
    """Rows with aggregates of their group, as columns of these names; total: how many rows there are, or more. A null key's rows are dropped."""
    n = f"{P}group_rows"
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias(n), *(v.alias(k) for k, v in values.items()))
    return joined(rows, found, key, n, total).drop(n)


def joined(rows: DataFrame, known: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Rows with the columns of `known`, one row for each key, whose column n says how many of the `total` rows have the key."""
    limit = max(LEAST_HEAVY, -(-total // MOST_HEAVY))
    if total <= limit:
        return rows.join(known, key)
    rest = [c for c in known.columns if c != key]
    heavy = known.filter(F.col(n) > limit).select(F.col(key).alias(f"{P}heavy"), *(F.col(c).alias(f"{P}heavy_{c}") for c in rest))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col(f"{P}heavy"), "left")
    large = marked.filter(F.col(f"{P}heavy").isNotNull()).select(*rows.columns, *(F.col(f"{P}heavy_{c}").alias(c) for c in rest))
    small = marked.filter(F.col(f"{P}heavy").isNull()).select(*rows.columns).join(known.filter(F.col(n) <= limit), key)
    return large.unionByName(small)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_group(both, "u", 2 * n, m=F.least("u", F.min("v"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = with_group(down, "u", n, m=F.min("v"))
    return moved.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges u, v (long, u != v) to rows u, v: each node that isn't its component's least, and that least node."""
    edges = written(edges.select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        last, half = edges, written(_large_star(edges, state[0]), "edges")
        edges = written(_small_star(half, 2 * state[0]), "edges")
        discard(last)
        discard(half)
        was, state = state, _state(edges)
        if was == state:
            break
    return edges
