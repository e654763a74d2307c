"""Quality scores from preferences: Bradley-Terry with a logistic loss on feature differences.

Each preference pair is a labelled document of quality 1 and one of quality 0; the chance that the first
is preferred is the logistic function of the difference of their scores, linear in the features. A
feature is a bin of a plain measure of the text (quantile bins of all learned documents), so the score is an
additive step function. Fitting uses all labelled documents and all their pairs: a document's part in the loss is a sum over
the other side's scores, on a grid. The driver gets how many documents there are of each measure's cell (values to 10
binary digits), for the quantiles, and then of each distinct row of bins, some 25 bytes each. The reported score is the logistic
function of the distance to the threshold, which is the quantile of the learned documents' scores at their
share of quality 0; a document above the threshold scores `CUT` or more.

Defined results: a null or empty text is scored like any other (its measures are 0), a very long one whole; without
labels of both kinds every document scores the share of quality 1; equal scores get one verdict, on the threshold `CUT`
itself 1; repeated rows are scored one by one; a doc_id with several labels counts with the lowest, one with several texts
is learned from the least row of measures; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, discard, written

BINS, CUT = 16, 0.7
#: Steps of the fit, and its ridge.
STEPS, RIDGE = 300, 1e-4
#: Cells of the scores' grid in which pairs are summed.
GRID = 2_048
#: Low bits of a measure, as a 32-bit float, that its quantiles do without.
LOW = 13
#: Words in the windows whose repeats are measured.
WINDOW = 8
MEASURES = ("log_words", "word_length", "alpha", "upper", "digit", "space", "symbol", "mark", "high", "repeated_words", "repeated_lines", "distinct", "top_word", "line_words")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode("latin-1"))] = 1
    return out


_CLASSES = np.stack([
    _table("abcdefghijklmnopqrstuvwxyz") + _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"),
    _table(" \t\n\x0b\x0c\r"), _table("#*$%&|<>"), _table("!?@=_{}[]\\/~^+"), (np.arange(256) >= 128).astype(np.int64),
], axis=1)


def measures(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, *shares, 0.0, 0.0, 0.0, 0.0, 0.0]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        key = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(key)]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            hit = np.zeros(n + 1, np.int64)
            at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + WINDOW, -1)
            repeated = int((np.cumsum(hit)[:n] > 0).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = Counter(words)
    return [math.log1p(n), (len(raw) - raw.count(b" ")) / n, *shares, repeated / n, 1 - len(set(lines)) / len(lines), len(count) / n, max(count.values()) / n, min(1.0, n / len(lines) / 100)]


@dataclass
class Ranker:
    """edges: bin limits of each measure; weights: of each bin; zero: the threshold; base: what to score without weights."""

    edges: np.ndarray
    weights: np.ndarray | None
    zero: float
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(self.weights[k][np.searchsorted(self.edges[k], x[:, k], side="right")] for k in range(x.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.zero + math.log(CUT / (1 - CUT)), -50, 50)))


def pull(scores: np.ndarray, others: np.ndarray, sign: int, many: np.ndarray | None = None) -> np.ndarray:
    """For each score the mean over all others, each so many times, of logistic(sign * (other - score)): how far its pairs are lost.

    Others are counted on a grid of scores with linear weights, so that all pairs cost a convolution on the grid."""
    low, high = float(min(scores.min(), others.min())), float(max(scores.max(), others.max()))
    step = max((high - low) / (GRID - 1), 1e-12)
    many = np.ones(len(others)) if many is None else many
    at = (others - low) / step
    k = np.minimum(at.astype(np.int64), GRID - 2)
    weight = np.bincount(k, many * (1 - (at - k)), GRID) + np.bincount(k + 1, many * (at - k), GRID)
    apart = step * np.arange(1 - GRID, GRID)
    lost = np.convolve(1 / (1 + np.exp(np.clip(sign * apart, -50, 50))), weight, "valid") / many.sum()
    # values on the grid, between which scores are interpolated
    mine = (scores - low) / step
    j = np.minimum(mine.astype(np.int64), GRID - 2)
    return lost[j] + (lost[j + 1] - lost[j]) * (mine - j)


def binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], side="right") for k in range(len(edges))], axis=1).astype(np.uint8)


def fit_pairs(x: np.ndarray, label: np.ndarray) -> Ranker:
    """The ranker of documents in memory."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(MEASURES), BINS - 1))
    return fit_bins(edges, binned(edges, x), label, np.ones(len(x)))


def fit_bins(edges: np.ndarray, bins: np.ndarray, label: np.ndarray, many: np.ndarray) -> Ranker:
    """Weights by gradient steps (Adam, full batch) on the logistic loss of all pairs with a ridge, of rows of bins, each so many times."""
    total = many.sum()
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    base = float((label * many).sum() / total) if total else 0.5
    if not len(good) or not len(bad):
        return Ranker(edges, None, 0.0, base)
    n = bins.shape[1]
    columns = np.ascontiguousarray(bins.T)
    w, m, v = (np.zeros((n, BINS)) for _ in range(3))
    raw = lambda: sum(w[k][columns[k]] for k in range(n))
    per_row = np.zeros(len(bins))
    for step in range(1, STEPS + 1):
        s = raw()
        # a good document's pairs pull it up, a bad one's down
        per_row[good] = -pull(s[good], s[bad], 1, many[bad]) * many[good] / many[good].sum()
        per_row[bad] = pull(s[bad], s[good], -1, many[good]) * many[bad] / many[bad].sum()
        g = np.stack([np.bincount(columns[k], per_row, BINS) for k in range(n)]) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = raw()
    order = np.argsort(s, kind="stable")
    so_far = np.cumsum(many[order])
    # the threshold lies between the scores on both sides of the quantile
    k = min(total - 1, max(1, round((1 - base) * total)))
    below, above = s[order[np.searchsorted(so_far, [k - 1, k], side="right")]]
    return Ranker(edges, w, float(below + above) / 2, base)


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *keep])

    kinds = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select("text", *keep).mapInArrow(run, f"x array<double>{kinds}")


@dataclass(frozen=True)
class Measured:
    """Written rows of doc_id and the measures, that `fit` and `scored` take in place of documents."""

    rows: DataFrame


def measured(docs: DataFrame) -> Measured:
    return Measured(written(_measured(docs, "doc_id").select("doc_id", F.col("x").alias(f"{P}x")), "measures"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))


def _edges(rows: DataFrame) -> np.ndarray:
    """Quantiles of each measure over all rows, on the cells of its values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _matrix(batch.column(0)).astype(np.float32).view(np.int32) >> LOW
            for k in range(len(MEASURES)):
                cell, n = np.unique(cells[:, k], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], names=["k", "cell", "n"])

    found = rows.select(f"{P}x").mapInArrow(count, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    k, cell, n = (found.column(c).to_numpy() for c in ("k", "cell", "n"))
    out = np.zeros((len(MEASURES), BINS - 1))
    for i in range(len(MEASURES)):
        own = np.flatnonzero(k == i)
        if len(own):
            own = own[np.argsort(cell[own])]
            so_far = np.cumsum(n[own])
            at = np.searchsorted(so_far, np.arange(1, BINS) / BINS * so_far[-1])
            out[i] = (cell[own][at] << LOW).astype(np.int32).view(np.float32)
    return out


def fit(docs: DataFrame | Measured, labels: DataFrame, learn: Column) -> Ranker:
    """Learns from all labelled documents that `learn` (of doc_id) marks."""
    rows = (docs if isinstance(docs, Measured) else measured(docs)).rows
    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias(f"{P}quality"))
    labelled = written(rows.join(known, "doc_id").groupBy("doc_id").agg(F.min(f"{P}x").alias(f"{P}x"), F.min(f"{P}quality").alias(f"{P}quality")).drop("doc_id"), "labelled")
    edges = _edges(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(edges, _matrix(batch.column(0)))
            yield pa.record_batch([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1)], names=["bins", "quality"])

    found = labelled.select(f"{P}x", f"{P}quality").mapInArrow(run, "bins binary, quality int").groupBy("bins", "quality").agg(F.count(F.lit(1)).alias("n")).toArrow()
    discard(labelled)
    bins = np.frombuffer(b"".join(found.column("bins").to_pylist()), np.uint8).reshape(-1, len(MEASURES))
    label, many = found.column("quality").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(float)
    order = np.lexsort((label, *bins.T))
    return fit_bins(edges, bins[order], label[order], many[order])


def scored(docs: DataFrame | Measured, ranker: Ranker) -> DataFrame:
    """Rows doc_id and score, of documents or of their measures."""
    known = isinstance(docs, Measured)
    docs = docs.rows if known else docs
    # plain values: a broadcast's classes are looked up by name, and workers need not have this package
    model = docs.sparkSession.sparkContext.broadcast((ranker.edges, ranker.weights, ranker.zero, ranker.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranker(*model.value)
        for batch in batches:
            x = _matrix(batch.column(1)) if known else np.array([measures(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(MEASURES))
            yield pa.record_batch([batch.column(0), pa.array(own.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", f"{P}x" if known else "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
