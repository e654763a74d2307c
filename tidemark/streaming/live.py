"""Live sources and a topic in a folder.

A push adapter's ticks are files of JSON lines, written whole and renamed, so a stream reader in any process sees
each tick once. A topic of `FolderBroker` is such a folder too; with a real broker the same manager uses Spark's
Kafka source and sink.
"""

from __future__ import annotations

import glob
import json
import os
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import current
from ..operators.feedback import LoopEdge


def _append(folder: str, lines: list[str]) -> None:
    os.makedirs(folder, exist_ok=True)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    part = f"{folder}/.{name}"
    with open(part, "w") as f:
        f.write("".join(x + "\n" for x in lines))
    os.rename(part, f"{folder}/{name}.json")


class GenericPushAdapter:
    """Ticks pushed by any thread; a burst's stamps strictly increase, over all adapters of the process.

    The folder is one that the pushing process and the executors share.
    """

    _lock, _last = threading.Lock(), 0

    def __init__(self, kind: str, folder: str):
        self.kind, self.folder, self.started = kind, folder, threading.Event()
        os.makedirs(folder, exist_ok=True)

    def wait_for_start(self, timeout: float | None = None) -> bool:
        """Blocks until a run reads the adapter; False if that takes longer."""
        return self.started.wait(timeout)

    def push_tick(self, value) -> None:
        self.push_all([value])

    def push_all(self, values: list) -> None:
        cls = GenericPushAdapter
        with cls._lock:
            stamps = []
            for _ in values:
                cls._last = max(cls._last + 1, time.time_ns() // 1000)
                stamps.append(cls._last)
        _append(self.folder, [json.dumps({"us": s, "v": v}) for s, v in zip(stamps, values)])

    def out(self, spark: SparkSession | None = None):
        """An edge of the live run that is being wired; with a session, a streaming DataFrame t, value."""
        run = current.get()
        if spark is None:
            if run is None or run.live is None:
                raise RuntimeError("a push adapter is an edge in a live run only: run(..., realtime=True)")
            name = next((k for k, a in run.adapters.items() if a is self), f"push{len(run.adapters)}")
            run.adapters[name] = self
            return LoopEdge(run.live, None, name)
        rows = spark.readStream.schema(f"us long, v {self.kind}").json(self.folder)
        return rows.select(F.timestamp_micros("us").alias("t"), F.col("v").alias("value"))


class NativePushAdapter(GenericPushAdapter):
    """Numbers and booleans only, gathered in a bounded buffer that a thread empties every `every` seconds: `push_tick` is False while it is full."""

    KINDS = ("long", "double", "boolean", "int", "float")

    def __init__(self, kind: str, folder: str, capacity: int = 65_536, every: float | None = 0.05):
        if kind not in self.KINDS:
            raise ValueError("a native adapter takes numbers and booleans")
        super().__init__(kind, folder)
        self.capacity, self.every, self._buffer, self._held, self._thread = capacity, every, [], threading.Lock(), None

    def push_tick(self, value) -> bool:
        with self._held:
            if len(self._buffer) >= self.capacity:
                return False
            self._buffer.append(value)
            if self._thread is None and self.every is not None:
                self._thread = threading.Thread(target=self._empty, daemon=True)
                self._thread.start()
        return True

    def _empty(self) -> None:
        while True:
            time.sleep(self.every)
            self.flush()

    def flush(self) -> int:
        with self._held:
            held, self._buffer = self._buffer, []
        if held:
            self.push_all(held)
        return len(held)


class FolderBroker:
    """Topics as folders: what a test needs of a broker."""

    def __init__(self, folder: str):
        self.folder = folder

    def topic(self, name: str) -> str:
        path = f"{self.folder}/{name}"
        os.makedirs(path, exist_ok=True)
        return path

    def preload(self, topic: str, messages: list) -> None:
        for m in messages:
            _append(self.topic(topic), [json.dumps({"value": m if isinstance(m, str) else json.dumps(m)})])

    def messages(self, topic: str) -> list[str]:
        return [json.loads(line)["value"] for p in sorted(glob.glob(f"{self.topic(topic)}/*.json")) for line in open(p)]

    def producer(self) -> Producer:
        return Producer(self)

    def consumer(self, *topics: str, latest: bool = False) -> Consumer:
        """Of all messages of the topics, or (latest) of those that come from now on."""
        return Consumer(self, topics, latest)


class Producer:
    """Sends messages: bytes and text as they are, all else as JSON."""

    def __init__(self, broker: FolderBroker):
        self.broker = broker

    def send(self, topic: str, value) -> None:
        self.broker.preload(topic, [value.decode() if isinstance(value, bytes) else value])

    def flush(self) -> None:
        """A message is there once it is sent."""

    def close(self) -> None:
        self.flush()


class Consumer:
    """Messages of some topics in the order in which they were sent to each."""

    def __init__(self, broker: FolderBroker, topics: tuple[str, ...], latest: bool):
        self.broker, self.at = broker, {t: len(broker.messages(t)) if latest else 0 for t in topics}

    def poll(self) -> list[tuple[str, object]]:
        """(topic, value) of what has come since the last poll; JSON values are decoded, all others are text."""
        out = []
        for topic, at in self.at.items():
            new = self.broker.messages(topic)[at:]
            self.at[topic] += len(new)
            out += [(topic, plain(m)) for m in new]
        return out

    def close(self) -> None:
        self.at = {}


def plain(message: str):
    """A JSON value, or else the text itself."""
    try:
        return json.loads(message)
    except ValueError:
        return message


def decoded(message: Column) -> Column:
    """The same as a column of variants."""
    text = F.variant_get(F.parse_json(F.to_json(F.array(message))), "$[0]", "variant")
    return F.coalesce(F.try_parse_json(message), text)


class KafkaAdapterManager:
    """Topics as streams of `value` strings, from a `FolderBroker` or bootstrap servers."""

    def __init__(self, spark: SparkSession, broker: FolderBroker | str):
        self.spark, self.broker = spark, broker

    def subscribe(self, topic: str, schema: str | None = None) -> DataFrame:
        """Messages from now on (all of a FolderBroker's): `value` as text and `decoded`, a variant of the JSON value or else of the text; with a schema, JSON values as columns."""
        if isinstance(self.broker, FolderBroker):
            rows = self.spark.readStream.schema("value string").json(self.broker.topic(topic))
        else:
            rows = self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.broker).option("subscribe", topic).option("startingOffsets", "latest").load()
            rows = rows.select(F.col("value").cast("string").alias("value"))
        return rows.select(F.from_json("value", schema).alias("m")).select("m.*") if schema else rows.select("value", decoded(F.col("value")).alias("decoded"))

    def publish(self, topic: str, stream: DataFrame, value: Column | None = None, checkpoint: str | None = None):
        """Starts a query that sends each row: a text column `value` as it is, else all columns as JSON."""
        text = value if value is not None else F.col("value") if dict(stream.dtypes).get("value") == "string" else F.to_json(F.struct("*"))
        rows = stream.select(text.alias("value"))
        if isinstance(self.broker, FolderBroker):
            folder = self.broker.topic(topic)

            def send(batch: DataFrame, _: int) -> None:
                batch.write.mode("append").json(folder)

            writer = rows.writeStream.foreachBatch(send)
        else:
            writer = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", self.broker).option("topic", topic)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()


def audited(stream: DataFrame, node: str, path: str, checkpoint: str):
    """Appends (time, node, value) of each tick to JSON lines while the stream runs."""

    def write(batch: DataFrame, _: int) -> None:
        batch.select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.lit(node).alias("node"), F.col("value").cast("string").alias("value")).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
