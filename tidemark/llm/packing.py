"""Best-fit packing: hierarchical residual packing.

Each partition tokenizes its documents, cuts only those longer than a sequence, and packs the pieces by
best-fit decreasing. Its bins become items of a second round, which packs those of all partitions best-fit
again. No task holds them: bins of one load are alike, so the round needs only how many there are of each load,
`capacity` numbers at most. Its plan is made of runs: bins of one load, from some rank on, each go to the next sequence of a
row of sequences, at one offset. A bin's rank is its place among the bins of its load in its partition and the number of
such bins in the partitions before; so each piece finds its run on its own. All bins take part, full ones too.

Defined results: a null or empty text is its end id alone, one piece of length 1; a very long one is cut into pieces of a
whole sequence, and a last one; an empty table gives no rows; repeated rows and equal doc_ids are packed one by one, each
with pieces of its own; of pieces of one length the earlier is packed first, and of bins of one load the last opened is
filled first; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, written
from .tokenize import word_ids

#: Pieces packed together in one go; bounds a task's memory.
CHUNK = 100_000
#: Documents tokenized in one go.
BATCH = 1_000
#: Bits of a rank.
RANK = 40

_PIECES = f"doc_id long, piece int, start long, length long, ids_crc32 long, {P}off long, {P}node int, {P}load int, {P}rank long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and each bin's load.

    The bins with room r are a stack; a bit mask of the r in use gives the tightest fit in a few word operations.
    """
    bins, offsets, loads = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += n
        if room - n:
            open_bins[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, loads


def fit_counts(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing of counts[n] items of each length n: runs (length, rank, items, sequence, offset), by length and rank.
    Item rank + i of the length goes to sequence + i.

    Sequences of the same room are taken together: each is filled with as many items as fit before the next, as one after another would be.
    """
    runs, opened, mask = [], 0, 0
    alike: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def left_with(room: int, first: int, many: int) -> None:
        nonlocal mask
        if room and many:
            alike[room].append((first, many))
            mask |= 1 << room

    for n in range(capacity, 0, -1):
        left, rank = int(counts[n]), 0
        while left:
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                first, many = alike[room].pop()
                if not alike[room]:
                    mask &= ~(1 << room)
            else:
                room, first, many = capacity, opened, -(-left // (capacity // n))
                opened += many
            # of them some take as many as fit, one what is left, the others none
            for items, used in ((room // n, min(many, left // (room // n))), (left % (room // n), 1)):
                if not items or not used or not many or not left:
                    continue
                runs += [(n, rank + k * used, used, first, capacity - room + k * n) for k in range(items)]
                left_with(room - items * n, first, used)
                rank, left, first, many = rank + items * used, left - items * used, first + used, many - used
            left_with(room, first, many)
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces_of(at: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose ids start at `at`: each piece's text, number and length."""
    sizes = np.diff(at)
    count = -(-sizes // capacity)
    text = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return text, piece, np.minimum(capacity, sizes[text] - piece * capacity)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, forward: int | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset. forward: bins of a pack that take part in the second
    round at most, the emptiest; None, as the queries have it, for all."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, n_held = TaskContext.get().partitionId(), [], 0
        words, seen = word_ids(tokenizer_path), np.zeros(capacity + 1, np.int64)

        def flush() -> pa.RecordBatch:
            doc, piece, length, crc = (np.concatenate(x) for x in zip(*held))
            bins, offsets, loads = best_fit(length, capacity)
            loads = np.array(loads, np.int64)
            order = np.argsort(loads, kind="stable")
            if forward is not None:
                loads[order[forward:]] = capacity  # as if full
                order = np.argsort(loads, kind="stable")
            count = np.bincount(loads, minlength=capacity + 1)
            rank = np.zeros(len(loads), np.int64)
            rank[order] = np.arange(len(loads)) - np.repeat(np.cumsum(count) - count - seen, count)
            seen[:] += count
            return pa.record_batch([
                pa.array(doc), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc), pa.array(offsets),
                pa.array(np.full(len(bins), node, np.int32)), pa.array(loads[bins].astype(np.int32)), pa.array(rank[bins]),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", f"{P}off", f"{P}node", f"{P}load", f"{P}rank"])

        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                ids, at = words.encode(batch.column(1).to_pylist(), end_id)
                text, piece, length = pieces_of(at, capacity)
                data = memoryview(ids.astype("<u4")).cast("B")
                first = at[text] + piece * capacity
                crc = np.fromiter((zlib.crc32(data[4 * s:4 * e]) for s, e in zip(first.tolist(), (first + length).tolist())), np.int64, len(first))
                held.append((np.array(batch.column(0).to_pylist(), dtype=object)[text], piece, length, crc))
                n_held += len(text)
                if n_held >= CHUNK:
                    yield flush()
                    held, n_held = [], 0
        if n_held:
            yield flush()

    pieces = written(docs.select("doc_id", "text").mapInArrow(local, _PIECES), "pieces")
    load, node, rank = (F.col(f"{P}{c}") for c in ("load", "node", "rank"))
    counts = written(pieces.groupBy(load, node).agg((F.max(rank) + 1).alias(f"{P}n")), "loads")
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy(load).agg(F.sum(f"{P}n").alias("n")).collect():
        total[r[f"{P}load"]] = r.n
    plan = docs.sparkSession.sparkContext.broadcast(fit_counts(total, capacity))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = plan.value.T
        starts = (length << RANK) + first
        for batch in batches:
            own = (batch.column(5).to_numpy().astype(np.int64) << RANK) + batch.column(6).to_numpy()
            at = np.searchsorted(starts, own, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence[at] + own - starts[at]), pa.array(offset[at] + batch.column(7).to_numpy())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum(f"{P}n").over(Window.partitionBy(load).orderBy(node)) - F.col(f"{P}n")
    ranked = pieces.join(counts.select(load, node, before.alias(f"{P}before")), [f"{P}load", f"{P}node"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", load, (rank + F.col(f"{P}before")).alias(f"{P}rank"), f"{P}off")
    return rows.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
