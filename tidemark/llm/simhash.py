"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions, correlated bits together. A fingerprint q has a threshold t_i in
each partition, -1 (skip) or more, adding up to K - m + 1; whatever lies within K bits of q then lies within
t_i bits of it in some partition i. A dynamic program chooses q's thresholds by the estimated cost: values
probed and candidates found there, counted beforehand from histograms of the partitions' values. Every
fingerprint is indexed by its value in each partition; probes go to the values within t_i and are verified
on all bits.

Equal fingerprints are one node. A bucket returns a spanning forest of its links, not its pairs. Buckets
above `BLOCK` rows are split into blocks of index rows and probes that meet pairwise, so a task holds one
block of index rows at most. m comes from the number of fingerprints by a cost model, within `PLAN_BYTES` for the
histograms, whatever the input: counts are kept in a byte each, rounded up, which is all that costs and blocks need.

Defined results: a null or empty text, or one without words, has fingerprint zero, and links like any other;
repeated rows get equal components; null doc_ids count as no id (a component of only such has none); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, checked, written
from .graph import components, joined, with_group

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Rows of a bucket's block; bounds a task's memory.
BLOCK = 8_192
#: Cells compared in one go.
CELLS = 1 << 21
#: Relative costs of a probe row and of a candidate.
ROW_COST, CANDIDATE_COST = 100.0, 1.0
_MAX_T = 2
#: Bytes of a plan's counts, which every worker has: one for each value of a partition and threshold.
PLAN_BYTES = 48 << 20
#: A count's byte: 0, 1 and 2 as they are, then the least k with 2 * GROWTH^(k - 2) or more.
GROWTH = 1.19
#: The most that each byte stands for.
MOST = np.concatenate([[0, 1], np.minimum(2 * GROWTH ** np.arange(254), 2.0**62)]).astype(np.int64)
#: Values of a partition whose counts come to the driver as one row.
RUN = 1 << 12


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included; a text of fewer words is one shingle. Empty without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1:].tolist())), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half the hashes. 0 without any."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[a:a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the shingles' hashes, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", f"{P}fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {P}fp long")


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def number_of_partitions(n: int, distance: int = DISTANCE) -> int:
    """The cheapest m for n evenly spread fingerprints, thresholds as equal as they can be."""

    def cost(m: int) -> float:
        width, spare = 64 / m, distance + 1 - m
        total = 0.0
        for i in range(m):
            t = spare // m + (i < spare % m)
            if t >= 0:
                total += ball(round(width), t) * (ROW_COST + CANDIDATE_COST * n / 2**width)
        return total

    return min((m for m in range(3, distance + 2) if plan_bytes(m) <= PLAN_BYTES), key=cost)


def plan_bytes(m: int) -> int:
    return sum((_MAX_T + 1) << (64 // m + (i < 64 % m)) for i in range(m))


def correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlations of the bits of all fingerprints, summed up on the executors."""

    def count(batches):
        total = np.zeros((65, 65), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for a in range(0, len(fp), 1 << 16):
                some = fp[a:a + (1 << 16)]
                bits = np.ones((len(some), 65), np.float32)
                bits[:, :64] = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(65 * 65, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "n"])

    total = np.zeros(65 * 65)
    for r in fps.select(f"{P}fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    total = total.reshape(65, 65)
    mean = total[:64, 64] / max(1, total[64, 64])
    cov = total[:64, :64] / max(1, total[64, 64]) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return np.abs(cov / np.outer(sd, sd))


def group_bits(rho: np.ndarray, m: int) -> list[list[int]]:
    """Greedily: from the bit most correlated with those left, add whichever is most correlated with the group."""
    left, groups = set(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (rho[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (rho[b, group].mean(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Of each partition, the value that its bits make, the first bit the lowest."""
    return [sum((((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(g)), np.zeros(len(fp), np.uint64)).astype(np.int64) for g in groups]


def near_counts(hist: np.ndarray, width: int, radius: int) -> list[np.ndarray]:
    """For radius 0, 1, ...: fingerprints with a value within it of each value."""
    at = np.arange(len(hist))
    exact = [hist.astype(np.int64)] + [np.zeros(len(hist), np.int64) for _ in range(radius)]
    for b in range(width):
        # values at distance k in the bits so far: those at k, and those at k - 1 with bit b flipped
        for k in range(radius, 0, -1):
            exact[k] = exact[k] + exact[k - 1][at ^ (1 << b)]
    return list(np.cumsum(exact, axis=0))


def coded(counts: np.ndarray) -> np.ndarray:
    """Each count's byte."""
    return np.searchsorted(MOST, counts).astype(np.uint8)


@dataclass
class Plan:
    """near: for each partition and threshold, the byte of the count of fingerprints with a value within it of each value."""

    groups: list[list[int]]
    near: list[list[np.ndarray]]
    distance: int

    def count(self, part: int, radius: int, values: np.ndarray) -> np.ndarray:
        """At least so many fingerprints as are there; 0 and 1 are exact."""
        return MOST[self.near[part][radius][values]]

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each fingerprint and partition, the threshold of least total cost; a dynamic program over the partitions."""
        m, n = len(self.groups), len(values[0])
        goal = self.distance + 1 - m  # of the thresholds' sum; at least -m
        states = goal + m + 1  # sums of (t + 1) so far: 0 .. goal + m
        best = np.full((states, n), np.inf)
        best[0] = 0
        took = np.zeros((m, states, n), np.int8)
        for i, (g, v) in enumerate(zip(self.groups, values)):
            now = np.full((states, n), np.inf)
            for t in range(-1, _MAX_T + 1):
                cost = 0.0 if t < 0 else ROW_COST * ball(len(g), t) + CANDIDATE_COST * self.count(i, t, v)
                for s in range(t + 1, states):
                    new = best[s - t - 1] + cost
                    better = new < now[s]
                    now[s] = np.where(better, new, now[s])
                    took[i, s][better] = t
            best = now
        out, s, at = np.zeros((n, m), np.int8), np.full(n, states - 1), np.arange(n)
        for i in range(m - 1, -1, -1):
            out[:, i] = took[i, s, at]
            s = s - out[:, i] - 1
        return out


def plan_for(fps: DataFrame, n: int, distance: int = DISTANCE, m: int | None = None) -> Plan:
    m = m or number_of_partitions(n, distance)
    groups = group_bits(correlation(fps), m)
    value = lambda g: sum((F.shiftleft(F.shiftrightunsigned(f"{P}fp", b).bitwiseAND(F.lit(1)), k) for k, b in enumerate(g)), F.lit(0)).cast("int")
    rows = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), value(g).alias("value")) for i, g in enumerate(groups)))).alias("x")).groupBy("x.part", "x.value").count()
    # a value and its count's byte as one number, runs of values as one row: four bytes for each of at most 2^width values of each partition
    byte = F.when(F.col("count") <= 2, F.col("count")).otherwise(2 + F.ceil(F.log(F.col("count") / 2) / F.lit(float(np.log(GROWTH))) - 1e-9)).cast("int")
    runs = rows.groupBy("part", F.floor(F.col("value") / RUN).cast("int").alias("run")).agg(F.collect_list((F.col("value") * 256 + byte)).alias("coded"))
    hists = [np.zeros(1 << len(g), np.uint8) for g in groups]
    for batch in runs.select("part", F.col("coded").cast("array<long>")).toArrow().to_batches():
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = x.values.to_numpy()
            hists[part][x >> 8] = x & 255
    near = []
    for h in hists:
        near.append([coded(x) for x in near_counts(MOST[h], len(h).bit_length() - 1, _MAX_T)])
    return Plan(groups, near, distance)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b to a star forest with the same components: each node that isn't the least of its own, and that least."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ab[:len(a)], ab[len(a):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b some with the same components, as few as that takes."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ab[:len(a)], ab[len(a):]
    label, took = np.arange(len(nodes)), []
    while True:
        lx, ly = label[x], label[y]
        low, high = np.minimum(lx, ly), np.maximum(lx, ly)
        e = np.flatnonzero(low != high)
        if not len(e):
            break
        # each higher label joins the least one that it is linked to: no circles, as labels only fall
        e = e[np.lexsort((low[e], high[e]))]
        e = e[np.concatenate([[True], high[e][1:] != high[e][:-1]])]
        took.append(e)
        label[high[e]] = low[e]
        while (label[label] != label).any():
            label = label[label]
    at = np.concatenate([np.zeros(0, np.int64), *took])
    return a[at], b[at]


def links_within(index: np.ndarray, probes: np.ndarray, distance: int, forest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between index rows and probes, or (forest False) of each probe's links the nearest and the least;
    cells in strips, so memory is bounded."""
    us, vs = [], []
    step = max(1, CELLS // max(1, len(index)))
    for k in range(0, len(probes), step):
        q = probes[k:k + step]
        d = np.bitwise_count(q[:, None] ^ index[None, :])
        linked = (d <= distance) & (d > 0)
        if not forest:
            who = np.flatnonzero(linked.any(axis=1))
            near = np.where(linked[who], d[who], 99).argmin(axis=1)
            least = np.where(linked[who], index[None, :], np.uint64(2**64 - 1)).argmin(axis=1)
            us.append(np.concatenate([q[who], q[who]]))
            vs.append(np.concatenate([index[near], index[least]]))
            continue
        i, j = np.nonzero(linked)
        if len(i):
            u, v = (q[i], index[j]) if len(i) <= 2 * (len(q) + len(index)) else local_forest(q[i], index[j])
            us.append(u)
            vs.append(v)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return local_forest(np.concatenate(us), np.concatenate(vs)) if forest else (np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, plan: Plan, forest: bool = True) -> DataFrame:
    """Edges u, v whose components are those of all links within the distance; fps has distinct fingerprints.

    forest False: edges that are links themselves, from each fingerprint's nearest and least in each bucket."""
    spark = fps.sparkSession
    # plain values: a broadcast's classes are looked up by name, and workers need not have this package
    shared = spark.sparkContext.broadcast((plan.groups, plan.near, plan.distance))
    names = [f"{P}part", f"{P}value", f"{P}block", f"{P}kind", f"{P}fp"]
    keys = names[:3]

    def deal(batches):
        plan = Plan(*shared.value)
        masks = [[sum(1 << k for k in c) for r in range(1, _MAX_T + 1) for c in combinations(range(len(g)), r)] for g in plan.groups]
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            values = part_values(fp, plan.groups)
            t = plan.thresholds(values)
            mixed = ((fp ^ (fp >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
            for i, v in enumerate(values):
                width = len(plan.groups[i])

                def out(value, block, kind, who):
                    return pa.record_batch([pa.array(np.full(len(who), i, np.int32)), pa.array(value.astype(np.int32)), pa.array(block.astype(np.int64)), pa.array(np.full(len(who), kind, np.int32)), pa.array(who.view(np.int64))], names=names)

                def dealt(value, who, mix, kind):
                    # a bucket's index rows are in `a` blocks, its probes in `b`; index rows go to their row of blocks, probes to their column
                    a, b = 1 + plan.count(i, 0, value) // BLOCK, 1 + plan.count(i, _MAX_T, value) // (BLOCK * 64)
                    copies = b if kind == 0 else a
                    at = np.repeat(np.arange(len(who)), copies)
                    k = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    m = mix.astype(np.int64)[at]
                    block = (m % a[at]) * b[at] + k if kind == 0 else k * b[at] + m % b[at]
                    return out(value[at], block, kind, who[at])

                # nobody else is near: nobody probes it
                seen = plan.count(i, _MAX_T, v) > 1
                yield dealt(v[seen], fp[seen], mixed[seen], 0)
                for radius in range(_MAX_T + 1):
                    who = np.flatnonzero((t[:, i] >= radius) & seen)
                    if not len(who):
                        break
                    if radius == 0:
                        alone = plan.count(i, 0, v[who]) > 1
                        yield dealt(v[who][alone], fp[who][alone], mixed[who][alone], 1)
                        continue
                    for mask in masks[i][ball(width, radius - 1) - 1:ball(width, radius) - 1]:
                        other = v[who] ^ mask
                        there = plan.near[i][0][other] > 0
                        if there.any():
                            yield dealt(other[there], fp[who][there], mixed[who][there], 1)

    def meet(batches):
        key, parts, ready = None, [], None
        for batch in batches:
            part, value, block, kind, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = len(fp)
            if not n:
                continue
            fp = fp.view(np.uint64)
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
            edges = np.flatnonzero(new).tolist() + [n]
            us, vs = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                k = (part[a], value[a], block[a])
                if k != key:
                    key, parts, ready = k, [], None
                if kind[a] == 0:  # sorted before the probes
                    parts.append(fp[a:b])
                    ready = None
                elif parts:
                    if ready is None:
                        ready = np.concatenate(parts)
                    u, v = links_within(ready, fp[a:b], plan_distance, forest)
                    if len(u):
                        us.append(u)
                        vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                u, v = local_forest(u, v) if forest else spanning(u, v)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    plan_distance = plan.distance
    dealt = fps.select(f"{P}fp").mapInArrow(deal, f"{P}part int, {P}value int, {P}block long, {P}kind int, {P}fp long")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, f"{P}kind").mapInArrow(meet, "u long, v long")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def clustered(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Rows doc_id, fingerprint (hex), component_id, the least doc_id of all that are linked, over any number of steps, and
    cluster, a fingerprint that names the component."""
    fp, one, root, rows = f"{P}fp", f"{P}one", f"{P}root", f"{P}rows"
    docs_fp = written(fingerprints(docs, shingle), "fingerprints")
    # equal fingerprints are one node
    fps = written(docs_fp.groupBy(fp).agg(F.min("doc_id").alias(one), F.count(F.lit(1)).alias(rows)), "distinct")
    n = fps.count()
    if n > 1:
        found = components(links(fps, plan_for(fps, n, distance)))
        nodes = fps.join(found.select(F.col("u").alias(fp), F.col("v").alias(root)), fp, "left").withColumn(root, F.coalesce(root, fp))
        fps = with_group(nodes, root, n, component_id=F.min(one)).select(fp, "component_id", root, rows)
    else:
        fps = fps.select(fp, F.col(one).alias("component_id"), F.col(fp).alias(root), rows)
    return joined(docs_fp, fps, fp, rows, docs_fp.count()).select("doc_id", hex_of(fp).alias("fingerprint"), "component_id", hex_of(root).alias("cluster"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, that of the least doc_id, with the input's columns."""
    return one_of_each(docs, written(clustered(docs, shingle, distance), "clusters"), lambda t: f"{fingerprint(t, shingle):016x}")


def one_of_each(docs: DataFrame, found: DataFrame, name_of: Callable[[str], str]) -> DataFrame:
    """The row of the least doc_id of each cluster; found has doc_id, fingerprint, component_id and cluster, and name_of gives a text's fingerprint."""
    of_id, rows, least = f"{P}id", f"{P}rows", f"{P}least"
    counted = found.groupBy(F.col("doc_id").alias(of_id)).agg(F.count(F.lit(1)).alias(rows), F.min("component_id").alias(least))
    plain = F.col(of_id).isNotNull() & (F.col(rows) == 1)
    gone = checked(written(counted.filter(~plain | (F.col(of_id) != F.col(least))).select(of_id), "gone"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of_id)), "left_anti")
    # a doc_id on several rows, or null, doesn't name a row: of those in a component that it would stand for, the row of the least text stays
    shared = counted.filter(~plain).select(of_id)
    if shared.isEmpty():
        return out

    @F.pandas_udf("string")
    def name(texts):
        return texts.map(name_of)

    mine = docs.join(shared, F.col("doc_id").eqNullSafe(F.col(of_id)), "left_semi").select(F.struct(*(F.col(c) for c in docs.columns)).alias(f"{P}row"), name(F.coalesce("text", F.lit(""))).alias(f"{P}name"))
    where = found.select(F.col("fingerprint").alias(f"{P}hex"), F.col("cluster").alias(f"{P}cluster"), F.col("component_id").alias(least)).distinct()
    placed = mine.join(where, F.col(f"{P}name") == F.col(f"{P}hex")).filter(F.col(f"{P}row.doc_id").eqNullSafe(F.col(least)))
    one = placed.groupBy(f"{P}cluster").agg(F.min_by(f"{P}row", F.coalesce(f"{P}row.text", F.lit(""))).alias(f"{P}row"))
    return out.unionByName(one.select(f"{P}row.*"))
