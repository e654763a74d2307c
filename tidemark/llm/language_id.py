"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts the n-grams of at most about `FIT_DOCS` labelled documents (whole texts, chosen by a hash of
doc_id; all of them where there are fewer) on the executors. The matrix of log-probabilities, BUCKETS x
languages, is of fixed height and is broadcast. Scoring takes a batch's n-grams as a sparse row of bucket
hits for each document and adds up their matrix rows in numpy.

Defined results: a null text, or one without a letter (category L), is `und` with score 0; so is every text where no
labelled row can be learned from; where more rows than the bound share the few doc_ids, and the hash draws none, all
are learned from; very long texts are hashed whole, in a worker's memory one text at a time; ties go to the language first in alphabetical order; each input row
gives one row, repeated or not; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_DOCS = 10_000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Tasks that count, and so the number of partial matrices.
FIT_TASKS = 12
#: Characters hashed in one go; bounds a worker's memory beside a single text.
STEP_CHARS = 1_000_000


def has_letter(text: str) -> bool:
    """A character of a category that begins with L; numbers such as a half or a circled one are none."""
    import regex

    return regex.search(r"\p{L}", text) is not None


def ngram_buckets(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, the buckets of all their n-grams of one order, and where each text's begin.

    Texts are lowered and padded with spaces, wide enough that no n-gram has letters of two texts.
    """
    pad, a = " " * max(ORDERS), 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= STEP_CHARS):
            n += len(texts[b])
            b += 1
        parts = [pad + x.lower() for x in texts[a:b]]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
        codes = np.frombuffer(("".join(parts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes) - len(pad)
        key = np.zeros(n, np.uint32)
        for order in range(1, max(ORDERS) + 1):
            key = (key ^ codes[order - 1:order - 1 + n]) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
            if order in ORDERS:
                yield a, ((key * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16), starts
        a = b


def fit(docs: DataFrame, learn: Column, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the matrix of log-probabilities."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.select("doc_id").count()
    if not n:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = min(1.0, fit_docs / n)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, buckets, _ in ngram_buckets([t for k, t in zip(langs, texts) if k == lang]):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([own.astype("<i8").tobytes()])], names=["lang", "counts"])

    def add(pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(x, "<i8") for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    schema = "lang string, counts binary"
    counted = sample.select("lang", "text").repartition(FIT_TASKS).mapInArrow(count, schema)
    found = sorted(counted.groupBy("lang").applyInPandas(add, schema).collect(), key=lambda r: r.lang)
    if not found:  # the hash drew no row: rows of few doc_ids
        return fit(docs, learn, n) if share < 1 else ([], np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([np.frombuffer(r.counts, "<i8") for r in found], axis=1) + 0.5
    return [r.lang for r in found], np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predicted(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """Rows doc_id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
            pred, prob = np.full(len(texts), "und", object), np.zeros(len(texts))
            if at:
                total = np.zeros((len(at), len(langs)))
                for a, buckets, starts in ngram_buckets([texts[i] for i in at]):
                    for k in range(len(langs)):
                        total[a:a + len(starts), k] += np.add.reduceat(matrix[:, k][buckets], starts, dtype=np.float64)
                total -= total.max(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                pred[at] = np.array(langs, object)[best]
                prob[at] = 1 / np.exp(total).sum(axis=1)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(prob)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, learn: Column, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Learns from the rows that `learn` marks and predicts for all rows."""
    return predicted(docs, *fit(docs, learn, fit_docs))
