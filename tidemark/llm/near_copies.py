"""Near-duplicates by SimHash, verified by the Jaccard similarity of word shingles, and completed to be exact.

A text is the set of its 5-word shingles' hashes; equal sets are one node. The SimHash operator gives candidates: equal
fingerprints, and links found by its generalised pigeonhole probes. Sets of similarity `SIMILAR` can differ in more bits than
any probing radius reaches (at 0.8 about 10 of 64), so SimHash alone would lose links, and a prefix filter, which is exact,
completes it: in one order of all hashes, two similar sets share one of the first n - ceil(SIMILAR * n) + 1 of each. Rows of
equal prefix hashes are a crowd; sizes, positions, a sketch of 1024 bits and at last the whole texts decide on its pairs.
Hashes are counted in all distinct texts, and the most frequent come last in the order, so common passages make no crowds.

Large groups of copies must not cost a square. So first come SimHash's candidates and, of each crowd, the pairs of a row with
the one before it and with the first; they are verified few at a time, in each round of every component found so
far the candidate that looks nearest and the one that leads to the least other component. Only rows that are still in
different components then all meet in their crowds. A crowd of more than `BLOCK` rows, by its hash's texts or by its rows, is dealt
in blocks, in which only rows outside the crowd's largest component are probes; two blocks at most meet in a task.

Defined results: texts without words are equal; a text of fewer words than a shingle is one shingle; repeated
rows and null doc_ids are treated as in simhash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_ROWS, P, checked, discard, written
from .graph import components, joined, with_group
from .simhash import hex_of, majority, one_of_each, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
#: The count below which a hash is rare; hashes broadcast, at most.
OFTEN, MOST_OFTEN = 5, 100_000
#: Parts that the hashes are counted in, by their first bits, a power of 2; hashes that a task counts at once before it deals them.
PARTS, HELD = 1 << 12, 1 << 20
#: Rows of a crowd that are dealt to one task.
BLOCK = 8_192
#: Rounds in which each component's best candidates are verified.
ROUNDS = 2
#: Orders that rows of a crowd may have when they first meet.
ORDERS = 8
#: Pairs compared in one go.
CELLS = 1 << 20
#: Bits that a set's hashes are folded to; a power of 2.
BITS = 1 << 10


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def key_of(hashes: np.ndarray) -> int:
    """The name of a set."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes())


def folded(hashes: np.ndarray) -> bytes:
    """Bit b is 1 if an odd number of hashes fall to it: two sets differ in at least as many hashes as these in bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(65 - BITS.bit_length())).astype(np.int64), minlength=BITS) & 1).tobytes()


def prefix_length(n: int, similar: float = SIMILAR) -> int:
    return n - ceil(similar * n - 1e-9) + 1 if n else 0


def may_reach(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets of sizes a and b whose first common hash has positions i and j can be similar."""
    return 1 + np.minimum(a - i, b - j) - 1 >= similar / (1 + similar) * (a + b) - 1e-9


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text once; where few texts are repeated, only those are shuffled."""
    rows = docs.select(text_hash(), F.coalesce("text", F.lit("")).alias("text"))
    again = written(rows.groupBy(f"{P}text").count().filter("count > 1").select(f"{P}text"), "again")
    if again.count() > BROADCAST_ROWS:
        return rows.select("text").distinct()
    alone, several = (rows.join(F.broadcast(again), f"{P}text", how).select("text") for how in ("left_anti", "left_semi"))
    return alone.unionByName(several.distinct())


def counted(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows h, n: the hashes that `OFTEN` or more distinct texts have, and how many. All texts are counted. A written table."""

    def deal(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        edges = [*np.searchsorted(h, np.arange(PARTS, dtype=np.uint64) << np.uint64(65 - PARTS.bit_length())).tolist(), len(h)]
        n = n.astype("<u4")
        at = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.record_batch([pa.array([k for k, _, _ in at], pa.int32()), pa.array([h[a:b].tobytes() for _, a, b in at], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in at], pa.binary())], names=names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py(), shingle))
                rows += len(held[-1])
                if rows >= HELD:
                    yield deal(held)
                    held, rows = [], 0
        if rows:
            yield deal(held)

    def total(held):
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(n, first)
        return pa.record_batch([pa.array(h[first][n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["h", "n"])

    def add(batches):
        # rows arrive sorted by part
        last, held = None, []
        for batch in batches:
            for part, h, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != last and held:
                    yield total(held)
                    held = []
                last = part
                held.append((np.frombuffer(h, "<u8"), np.frombuffer(n, "<u4")))
        if held:
            yield total(held)

    names = [f"{P}{c}" for c in ("part", "h", "n")]
    dealt = distinct_texts(docs).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, ("int", "binary", "binary"))))
    return written(dealt.repartition(names[0]).sortWithinPartitions(names[0]).mapInArrow(add, "h long, n long"), "often")


def often(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes, ascending, and how many distinct texts have each: all from the least count on that at most `MOST_OFTEN` reach."""
    found = counted(docs, shingle)
    least, so_far = None, 0
    for r in sorted(found.groupBy("n").agg(F.count(F.lit(1)).alias("hashes")).collect(), key=lambda r: -r.n):
        so_far += r.hashes
        if so_far > MOST_OFTEN:
            break
        least = r.n
    rows = found.filter(F.col("n") >= least if least else F.lit(False)).toArrow()
    discard(found)
    h, n = (rows.column(k).to_numpy() for k in range(2))
    at = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[at], n[at]


def prefixes(docs: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Rows doc_id, key of the set, text (its hash), fp (SimHash of the shingles), size of the set, its folded bits, prefix, and for each hash of it the blocks of its crowd, 0 for one that is not dealt."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(often(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        blocks = np.ceil(counts / BLOCK).astype(np.int64)
        blocks[blocks < 2] = 0
        for batch in batches:
            keys, fps, sizes, bits, heads, dealt = [], [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                s = np.unique(hashes)
                keys.append(key_of(s))
                fps.append(majority(hashes))
                bits.append(folded(s))
                far = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    found = known[at] == s
                    order = np.argsort(np.where(found, counts[at], 0), kind="stable")
                    s, far = s[order], np.where(found, blocks[at], 0)[order]
                sizes.append(len(s))
                m = prefix_length(len(s), similar)
                heads.append(s[:m].view(np.int64))
                dealt.append(far[:m])
            yield pa.record_batch([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()),
                                   pa.array(heads, pa.list_(pa.int64())), pa.array(dealt, pa.list_(pa.int32()))], names=["doc_id", *(f"{P}{c}" for c in ("key", "text", "fp", "size", "bits", "prefix", "blocks"))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, f"doc_id {kind}, {P}key long, {P}text long, {P}fp long, {P}size int, {P}bits binary, {P}prefix array<long>, {P}blocks array<int>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias(f"{P}text")


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first n, cut only where those change."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [sketches(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:n]], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        kept = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if kept is not None:
        yield kept


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of sets with one fingerprint, or with fingerprints that the pigeonhole probes find."""
    key, fp, head = f"{P}key", f"{P}fp", f"{P}head"
    n = nodes.count()
    heads = written(nodes.groupBy(fp).agg(F.min(key).alias(head)), "heads")
    distinct = heads.count()
    equal = with_group(nodes.select(key, fp), fp, n, **{head: F.min(key)}).filter(F.col(key) != F.col(head)).select(F.col(head).alias("u"), F.col(key).alias("v"))
    if distinct < 2:
        return equal
    found = written(simhash.links(heads, simhash.plan_for(heads, distinct), forest=False).distinct(), "near")
    a, b = (heads.select(F.col(fp).alias(c), F.col(head).alias(f"{P}{c}")) for c in "uv")
    near = found.join(a, "u").join(b, "v").select(F.least(f"{P}u", f"{P}v").alias("u"), F.greatest(f"{P}u", f"{P}v").alias("v")).distinct()
    return equal.unionByName(near)


def apart(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """For sets of sizes a and b with sketches x and y: the share of hashes in which they differ at least, and whether they can be similar."""
    bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    both = a.astype(np.int64) + b
    return (bits / np.maximum(1, both)).astype(np.float32), (both - bits) / 2 >= similar / (1 + similar) * both - 1e-9


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


class Pairs:
    """Pairs of rows that can be similar, each once, as record batches u, v, apart."""

    def __init__(self, similar: float):
        self.similar, self.held, self.n = similar, [], 0

    def add(self, key, size, sketch, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for c in range(0, len(i), CELLS // 16):
            x, y = i[c:c + CELLS // 16], j[c:c + CELLS // 16]
            far, good = apart(size[x], sketch[x], size[y], sketch[y], self.similar)
            x, y = key[x[good]], key[y[good]]
            self.held.append((np.minimum(x, y), np.maximum(x, y), far[good]))
            self.n += len(x)
            if self.n >= CELLS // 16:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        u, v, far = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        self.held, self.n = [], 0
        _, first = np.unique(np.stack([u, v], axis=1), axis=0, return_index=True)
        return pa.record_batch([pa.array(u[first]), pa.array(v[first]), pa.array(far[first])], names=["u", "v", "apart"])


_PAIRS = "u long, v long, apart float"


def once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.min("apart").alias("apart"))


def crowds(nodes: DataFrame) -> DataFrame:
    """Rows h, key, size, at, n (blocks) of prefix hashes that several sets have: few, as most shingles are one text's. A written table."""
    names = [f"{P}{c}" for c in ("h", "key", "size", "at")]

    def run(batches):
        # rows arrive sorted by hash; one that is alone so far waits for the next
        last, waits = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            h = columns[0]
            before = np.concatenate([[last is not None and last == h[0]], h[1:] == h[:-1]])
            keep = before.copy()
            keep[:-1] |= h[1:] == h[:-1]
            if waits is not None and before[0]:
                yield waits
            alone = not keep[-1]
            last, waits = h[-1], pa.record_batch([c[-1:] for c in batch.columns], names=names) if alone else None
            if keep.any():
                yield pa.record_batch([pa.array(c[keep]) for c in columns], names=names)

    entries = nodes.select(f"{P}key", f"{P}size", f"{P}blocks", F.posexplode(f"{P}prefix").alias(f"{P}at", f"{P}h")).withColumn(f"{P}n", F.get(f"{P}blocks", F.col(f"{P}at")))
    rare = entries.filter(F.col(f"{P}n") == 0).select(*names).repartition(f"{P}h").sortWithinPartitions(f"{P}h").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, ("long", "long", "int", "int"))))
    found = written(rare.withColumn(f"{P}n", F.lit(0)).unionByName(entries.filter(F.col(f"{P}n") > 0).select(*names, f"{P}n")), "crowds")
    # crowds of hashes that are not broadcast are counted here, whatever the input's size
    sizes = found.groupBy(f"{P}h").agg(F.count(F.lit(1)).alias(f"{P}rows"), F.max(f"{P}n").alias(f"{P}guess")).filter(F.col(f"{P}rows") > BLOCK * F.greatest(f"{P}guess", F.lit(1)))
    large = written(sizes.select(f"{P}h", F.ceil(F.col(f"{P}rows") / BLOCK).cast("int").alias(f"{P}blocks")), "large")
    if large.isEmpty():
        return found
    out = written(found.join(checked(large), f"{P}h", "left").select(*names, F.coalesce(f"{P}blocks", f"{P}n").alias(f"{P}n")), "crowds")
    for x in (found, large):
        discard(x)
    return out


def with_sketch(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select(f"{P}key", f"{P}bits"), f"{P}key")


def first_pairs(entries: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Candidates: each row with the one before it and the first of its crowd, or of its block of the crowd."""
    names = [f"{P}{c}" for c in ("h", "own", "size", "at", "key", "bits")]

    def meet(batches):
        out, first, last = Pairs(similar), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, own, size, at, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            sketch = sketches(batch.column(5))
            # the first of the crowd that goes on, and its last row, stand before the batch's rows
            kept = [x for x in (first, last) if x is not None]
            h, own, size, at, key, sketch = (np.concatenate([*(k[c] for k in kept), x]) for c, x in enumerate((h, own, size, at, key, sketch)))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            i = np.flatnonzero(~new)
            i = i[i >= len(kept)]
            i, j = np.concatenate([i, i]), np.concatenate([i - 1, start[i]])
            good = (key[i] != key[j]) & may_reach(size[i], at[i], size[j], at[j], similar)
            yield from out.add(key, size, sketch, i[good], j[good])
            first, last = ([x[k:k + 1] for x in (h, own, size, at, key, sketch)] for k in (int(start[-1]), len(h) - 1))
        yield out.batch()

    own = F.when(F.col(f"{P}n") > 0, F.pmod(F.xxhash64(f"{P}key"), F.greatest(f"{P}n", F.lit(1)))).otherwise(F.lit(0)).cast("int").alias(f"{P}own")
    rows = with_sketch(entries.select(f"{P}h", own, f"{P}size", f"{P}at", f"{P}key"), nodes).select(*names)
    return rows.repartition(f"{P}h", f"{P}own").sortWithinPartitions(f"{P}h", f"{P}own", F.xxhash64(F.pmod(f"{P}h", F.lit(ORDERS)), f"{P}key")).mapInArrow(meet, _PAIRS)


def other_pairs(entries: DataFrame, nodes: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Candidates: all rows of a crowd that are in different components."""
    names = [f"{P}{c}" for c in ("h", "block", "size", "at", "key", "root", "side", "bits")]

    def compared(s, p, k, r, side, sketch, out) -> Iterator[pa.RecordBatch]:
        """Rows of one crowd's block, sorted by size; pairs of different sides, or all where there are no sides (0)."""
        step = max(1, CELLS // len(s))
        for c in range(0, len(s), step):
            # partners come later, and are at most so much larger
            last = int(np.searchsorted(s, s[min(c + step, len(s)) - 1] / similar + 1e-9, "right"))
            x, y = slice(c, c + step), slice(c, last)
            good = may_reach(s[x, None], p[x, None], s[None, y], p[None, y], similar) & (r[x, None] != r[None, y]) & ((side[x, None] != side[None, y]) | (side[x, None] == 0))
            i, j = np.nonzero(good)
            yield from out.add(k, s, sketch, i + c, j + c)

    def meet(batches):
        out = Pairs(similar)
        for h, block, size, at, key, root, side, sketch in runs(batches, 2):
            edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x = slice(a, b)
                if b - a > 1:
                    yield from compared(size[x], at[x], key[x], root[x], side[x], sketch[x], out)
        yield out.batch()

    placed = entries.join(roots.select(F.col("u").alias(f"{P}key"), F.col("v").alias(f"{P}root")), f"{P}key", "left").withColumn(f"{P}root", F.coalesce(f"{P}root", f"{P}key"))
    placed = written(placed, "crowds")
    each = placed.groupBy(f"{P}h", f"{P}root").agg(F.count(F.lit(1)).alias(f"{P}rows")).groupBy(f"{P}h")
    # crowds with several components, and the largest of each
    own = F.max(f"{P}rows").alias(f"{P}own")
    main = written(each.agg(F.count(F.lit(1)).alias(f"{P}roots"), F.sum(f"{P}rows").alias(f"{P}rows"), own, F.max_by(f"{P}root", F.struct(f"{P}rows", f"{P}root")).alias(f"{P}main")).filter(F.col(f"{P}roots") > 1), "mixed")
    mixed = joined(placed, main, f"{P}h", f"{P}rows", placed.count())
    # in a dealt crowd, rows of the largest component are in n blocks, and all others, the probes, in some of their own; each
    # block of probes meets itself, the later ones, and the n others, so that a task holds two blocks at most
    n, probes, hashed = F.greatest(f"{P}n", F.lit(1)), F.greatest(F.ceil((F.col(f"{P}rows") - F.col(f"{P}own")) / BLOCK), F.lit(1)).cast("int"), F.xxhash64(f"{P}key")
    mine, place = F.pmod(hashed, probes).cast("int"), F.pmod(hashed, n).cast("int")

    def meeting(i, j, side):
        return F.struct((i * (probes + n) + j).cast("int").alias("block"), side.cast("int").alias("side"))

    of_probe = F.concat(F.transform(F.sequence(F.lit(0), probes - 1), lambda j: meeting(F.least(mine, j), F.greatest(mine, j), F.when(j == mine, 0).when(j > mine, 1).otherwise(2))),
                        F.transform(F.sequence(F.lit(0), n - 1), lambda k: meeting(mine, probes + k, F.lit(1))))
    of_main = F.transform(F.sequence(F.lit(0), probes - 1), lambda i: meeting(i, probes + place, F.lit(2)))
    block = F.when(F.col(f"{P}n") == 0, F.array(meeting(F.lit(0), F.lit(0), F.lit(0)))).when(F.col(f"{P}root") != F.col(f"{P}main"), of_probe).otherwise(of_main)
    spread = mixed.select(f"{P}h", F.explode(block).alias(f"{P}x"), f"{P}size", f"{P}at", f"{P}key", f"{P}root")
    dealt = with_sketch(spread.select("*", F.col(f"{P}x.block").alias(f"{P}block"), F.col(f"{P}x.side").alias(f"{P}side")), nodes).select(*names)
    return dealt.repartition(f"{P}h", f"{P}block").sortWithinPartitions(f"{P}h", f"{P}block", f"{P}size", f"{P}key").mapInArrow(meet, _PAIRS)


def close(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Pairs u, v whose sketches don't rule similarity out, with `apart`."""
    def can_be(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            far, good = apart(a, sketches(batch.column(3)), b, sketches(batch.column(5)), similar)
            yield pa.record_batch([c.filter(pa.array(good)) for c in (*batch.columns[:2], pa.array(far))], names=["u", "v", "apart"])

    a, b = (nodes.select(F.col(f"{P}key").alias(c), F.col(f"{P}size").alias(f"{P}n{c}"), F.col(f"{P}bits").alias(f"{P}b{c}")) for c in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", f"{P}nu", f"{P}bu", f"{P}nv", f"{P}bv").mapInArrow(can_be, _PAIRS)


def texts_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each set that is in a pair, read again: sets of all texts would be larger than the texts."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias(f"{P}key")).distinct()
    named = checked(written(nodes.select(f"{P}key", f"{P}text").join(ends, f"{P}key", "left_semi"), "ends"))
    found = docs.select(text_hash(), F.coalesce("text", F.lit("")).alias(f"{P}t")).join(named, f"{P}text")
    return written(found.groupBy(f"{P}key").agg(F.min(f"{P}t").alias(f"{P}t")), "texts")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Those pairs whose whole sets are similar. Texts move, not sets: they are half as large, and compress."""
    def check(batches):
        last = {}

        def of(side, key, text):
            if last.get(side, (None,))[0] != key:
                last[side] = (key, shingle_set(text, shingle))
            return last[side][1]

        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k in range(batch.num_rows):
                x, y = of(0, u[k], batch.column(2)[k].as_py()), of(1, v[k], batch.column(3)[k].as_py())
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                good.append(same >= similar * (len(both) - same) - 1e-9)
            yield pa.record_batch([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    a, b = (texts.select(F.col(f"{P}key").alias(c), F.col(f"{P}t").alias(f"{P}{c}")) for c in "uv")
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", f"{P}u", f"{P}v").mapInArrow(check, "u long, v long")


def grown(candidates: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """A written table: of the candidates u, v, apart some that are similar, chosen round by round from what each component has."""
    found, left = None, candidates
    for _ in range(ROUNDS):
        if found is None:
            now = left.select("u", "v", "apart", F.col("u").alias("ru"), F.col("v").alias("rv"))
        else:
            roots = components(found)
            a, b = (roots.select(F.col("u").alias(c), F.col("v").alias(f"r{c}")) for c in "uv")
            now = left.join(a, "u", "left").join(b, "v", "left").select("u", "v", "apart", F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv")).filter("ru != rv")
        # of each component the nearest, and that to the least other one
        sides = now.select("u", "v", "apart", F.inline(F.array(F.struct(F.col("ru").alias("own"), F.col("rv").alias("other")), F.struct(F.col("rv").alias("own"), F.col("ru").alias("other")))))
        best = sides.groupBy("own").agg(F.min(F.struct("apart", "u", "v")).alias("a"), F.min(F.struct("other", "apart", "u", "v")).alias("b"))
        chosen = written(best.select(F.inline(F.array(F.struct("a.u", "a.v"), F.struct("b.u", "b.v")))).distinct(), "chosen")
        new = verified(chosen, texts, shingle, similar)
        last, found = found, written(new if found is None else found.unionByName(new), "links")
        if last is not None:
            discard(last)
            discard(roots)
        left = left.join(chosen, ["u", "v"], "left_anti")
    return found


def clustered(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Rows doc_id, fingerprint (hex, names the text's set), component_id, the least doc_id of all that are linked, over any
    number of steps, and cluster, a fingerprint that names the component. A written table."""
    key, one, root, rows = f"{P}key", f"{P}one", f"{P}root", f"{P}rows"
    of_docs = written(prefixes(docs, shingle, similar), "prefixes")
    # one row of each set
    rest = [f"{P}{c}" for c in ("text", "fp", "size", "bits", "prefix", "blocks")]
    nodes = written(of_docs.groupBy(key).agg(F.min("doc_id").alias(one), F.count(F.lit(1)).alias(rows), F.min_by(F.struct(*rest), F.struct(f"{P}text", f"{P}fp")).alias(f"{P}x")).select(key, one, rows, *(F.col(f"{P}x.{c}").alias(c) for c in rest)), "sets")
    placed = written(of_docs.select("doc_id", key), "keys")
    discard(of_docs)
    n = nodes.count()
    rows_of = crowds(nodes)
    pool = written(once(close(simhash_candidates(nodes), nodes, similar).unionByName(first_pairs(rows_of, nodes, similar))), "candidates")
    texts = texts_of(pool, docs, nodes)
    links = grown(pool, texts, shingle, similar)
    more = written(once(other_pairs(rows_of, nodes, components(links), similar)), "candidates")
    for x in (pool, texts, rows_of):
        discard(x)
    texts = texts_of(more, docs, nodes)
    found = written(links.unionByName(verified(more, texts, shingle, similar)), "links")
    for x in (more, texts, links):
        discard(x)
    roots = components(found).select(F.col("u").alias(key), F.col("v").alias(root))
    named = nodes.select(key, one, rows).join(roots, key, "left").withColumn(root, F.coalesce(root, key))
    known = with_group(named, root, n, component_id=F.min(one)).select(key, "component_id", root, rows)
    out = written(joined(placed, known, key, rows, placed.count()).select("doc_id", hex_of(key).alias("fingerprint"), "component_id", hex_of(root).alias("cluster")), "clusters")
    for x in (nodes, placed, found):
        discard(x)
    return out


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One document of each component, that of the least doc_id, with the input's columns."""
    return one_of_each(docs, clustered(docs, shingle, similar), lambda t: f"{key_of(shingle_set(t, shingle)):016x}")
