"""Token ids in Arrow stream-file (IPC file) format.

A shard file holds record batches of two fixed-size-list columns: `tokens` (SEQ_LEN ids each, 16 bits
where the vocabulary allows) and `mask` (true where there is a token; only a shard's last sequence is
padded). Files are uncompressed, so a memory-mapped sequence i is a view: batch i // BATCH_SEQS, values
at (i % BATCH_SEQS) * SEQ_LEN. Beside it lies a file of the documents (doc_id, start in the shard,
n_tokens). Shards follow ascending doc_id; a manifest lists the files of the tasks that succeeded, so a
task that ran twice or was lost leaves nothing that is read.

Defined results: a null or empty text is its end id alone; a very long one is whole, over as many sequences as it
needs; equal doc_ids keep one entry each, ordered by a hash of the text and the text; an empty table gives no shards and no rows; null doc_ids come first; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, shared_path, written
from .tokenize import word_ids

SEQ_LEN, BATCH_SEQS = 2048, 256
#: Documents tokenized in one go.
BATCH = 1_000
_MANIFEST = "shard int, tokens_path string, docs_path string, n_docs long, n_tokens long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class ShardWriter:
    """Appends ids; a full batch of sequences is written at once, so memory is bounded."""

    def __init__(self, sink, wide: bool, seq_len: int = SEQ_LEN, batch_seqs: int = BATCH_SEQS):
        self.kind, self.seq_len, self.step = (np.uint32 if wide else np.uint16), seq_len, seq_len * batch_seqs
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.file, self.held, self.n_held, self.n = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.step:
            flat = np.concatenate(self.held)
            full = len(flat) // self.step * self.step
            for a in range(0, full, self.step):
                self._batch(flat[a:a + self.step], self.step)
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _batch(self, flat: np.ndarray, n: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:n] = True
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.seq_len, self.kind)]), len(flat))
        self.file.close()


class ShardReader:
    """Random access to a shard's sequences; views of the mapped file where it is local."""

    def __init__(self, path: str):
        fs, p = _open(path)
        self.source = pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("tokens").type.list_size
        self.batch_seqs = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._at, self._ids = -1, None

    def batch(self, i: int) -> np.ndarray:
        """Ids of batch i, without padding."""
        if i != self._at:
            b = self.file.get_batch(i)
            ids = b.column("tokens").values.to_numpy(zero_copy_only=True)
            if i == self.file.num_record_batches - 1:
                ids = ids[:b.column("mask").values.true_count]
            self._at, self._ids = i, ids
        return self._ids

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, k = self.file.get_batch(i // self.batch_seqs), i % self.batch_seqs
        at = slice(k * self.seq_len, (k + 1) * self.seq_len)
        return b.column("tokens").values.to_numpy(zero_copy_only=True)[at], b.column("mask").values[at.start:at.stop].to_numpy(zero_copy_only=False)

    def parts(self, start: int, end: int) -> Iterator[np.ndarray]:
        step = self.seq_len * self.batch_seqs
        while start < end:
            i = start // step
            stop = min(end, (i + 1) * step)
            yield self.batch(i)[start - i * step:stop - i * step]
            start = stop


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes the files under `folder` and returns the manifest, a row for each shard that has documents."""
    folder = _uri(folder)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        words, writer, index, start = word_ids(tokenizer_path), None, None, 0
        n_docs = 0
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                if writer is None:
                    fs, base = _open(folder)
                    fs.create_dir(base, recursive=True)
                    paths = [f"{folder}/{number:05d}-{name}.{kind}.arrow" for kind in ("tokens", "docs")]
                    sinks = [fs.open_output_stream(_open(p)[1]) for p in paths]
                    writer = ShardWriter(sinks[0], words.tokenizer.get_vocab_size() > 1 << 16, seq_len)
                    index = pa.ipc.new_file(sinks[1], _DOCS)
                ids, at = words.encode(batch.column(1).to_pylist(), end_id)
                writer.append(ids)
                index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at))], schema=_DOCS))
                start += len(ids)
                n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "tokens_path": [paths[0]], "docs_path": [paths[1]], "n_docs": [n_docs], "n_tokens": [start]})

    # ranges of doc_id, and of equal or null ones of the text's hash, so that no task holds more than its share
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(dealt.mapInArrow(shard, _MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32, shard, sequence, read from the files that the manifest lists."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["tokens_path"])
                fs, p = _open(row["docs_path"])
                with fs.open_input_file(p) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        b = index.get_batch(i)
                        starts, counts = b.column(1).to_numpy(), b.column(2).to_numpy()
                        crcs = np.zeros(len(starts), np.int64)
                        for k, (s, n) in enumerate(zip(starts.tolist(), counts.tolist())):
                            crc = 0
                            for ids in shard.parts(s, s + n):
                                crc = zlib.crc32(ids.astype("<u4").data, crc)
                            crcs[k] = crc
                        yield pa.record_batch([b.column(0), pa.array(starts + row["base"]), b.column(2), pa.array(crcs), pa.array(np.full(len(starts), row["shard"], np.int32)), pa.array(starts // shard.seq_len)],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "sequence"])

    # a row for each shard: as few as the write had tasks
    rows, base, listed = sorted(manifest.collect(), key=lambda r: r.shard), 0, []
    for r in rows:
        listed.append((r.shard, r.tokens_path, r.docs_path, base))
        base += r.n_tokens
    shards = spark.createDataFrame(listed, "shard int, tokens_path string, docs_path string, base long")
    return shards.repartition(max(1, len(listed))).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, sequence long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the files to a new shared folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, end_id, shared_path(spark, "token-files")))
