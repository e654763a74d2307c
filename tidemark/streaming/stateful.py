"""Nodes on structured streams.

Micro-batches can bring a key's rows in any order, so rows wait in a key's state, by the second they belong to,
until the watermark has passed that second; then they are folded in time order, rows of one time as one cycle, and
the node's memory is kept for what comes next. A timer reads only the seconds that are due. Rows later than the
watermark are dropped. At the end of a bounded replay the watermark doesn't move any more: add a far row, whose key
is dropped from the output.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import shared_folder, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Time of the row that ends a bounded replay.
FAR = datetime(2200, 1, 1)
#: Microseconds whose rows wait together.
BUCKET = 1_000_000


def processor_of(folding, scalars: dict, keys: list[str], inputs: list[str], outs: list[str]) -> StatefulProcessor:
    """Reorders a key's rows by time and feeds them to a node's fold.

    Spark also loads the processor in a process on the driver that has no shipped sources, to ask for its states: so the class
    is sent whole, and what needs this package is unpacked only where rows are.
    """
    packed = cloudpickle.dumps((folding, scalars, keys, inputs, outs))

    class Folding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            binary = T.StructType([T.StructField("data", T.BinaryType())])
            self.handle = handle
            # rows by bucket; the buckets that wait, ascending; the fold's memory
            self.rows = handle.getMapState("rows", T.StructType([T.StructField("bucket", T.LongType())]), binary)
            self.waiting = handle.getValueState("waiting", binary)
            self.kept = handle.getValueState("kept", binary)

        def _own(self):
            if not hasattr(self, "own"):
                from tidemark.streaming.stateful import Folded

                self.own = Folded(self, *pickle.loads(packed))
            return self.own

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
            yield self._own().take(rows)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
            yield self._own().fold(key, timerValues.getCurrentWatermarkInMs() * 1000)

        def close(self) -> None:
            pass

    return Folding()


class Folded:
    """What a processor does with a key's rows and timers; the states are its own."""

    def __init__(self, states, folding, scalars: dict, keys: list[str], inputs: list[str], outs: list[str]):
        self.states, self.folding, self.scalars, self.keys, self.inputs, self.outs = states, folding, scalars, keys, inputs, outs

    def take(self, rows):
        import pandas as pd

        new: dict[int, list] = {}
        for pdf in rows:
            for us, cells in zip(pdf["us"].tolist(), zip(*(pdf[c].tolist() for c in self.inputs)) if self.inputs else ((),) * len(pdf)):
                new.setdefault(us // BUCKET, []).append((us, [_cell(x) for x in cells]))
        held = self.states.rows
        for bucket, found in new.items():
            if held.containsKey((bucket,)):
                found = pickle.loads(held.getValue((bucket,))[0]) + found
            held.updateValue((bucket,), (pickle.dumps(found),))
        if new:
            waiting = sorted({*self._waiting(), *new})
            self.states.waiting.update((pickle.dumps(waiting),))
            self._timer(waiting[0])
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*self.keys, "us", "cyc", *self.outs)})

    def _waiting(self) -> list[int]:
        return pickle.loads(self.states.waiting.get()[0]) if self.states.waiting.exists() else []

    def _timer(self, bucket: int) -> None:
        """Fires once the watermark is past the bucket."""
        self.states.handle.registerTimer((bucket + 1) * BUCKET // 1000)

    def fold(self, key, mark: int):
        import pandas as pd

        waiting, kept = self._waiting(), self.states.kept
        ready = [b for b in waiting if (b + 1) * BUCKET <= mark]
        rest = waiting[len(ready):]
        fold = self.folding(**self.scalars)
        if kept.exists():
            fold.memory = pickle.loads(kept.get()[0])
        found = []
        for bucket in ready:
            for us, cells in merged(pickle.loads(self.states.rows.getValue((bucket,))[0])):
                found.extend(fold.feed(us, 0, cells))
            self.states.rows.removeKey((bucket,))
        # rows that wait may come before the watermark
        found.extend(fold.due(min([mark, *(b * BUCKET for b in rest[:1])])))
        kept.update((pickle.dumps(fold.memory),))
        self.states.waiting.update((pickle.dumps(rest),))
        # the next rows, or an alarm that comes before them
        after = rest[:1] + ([fold.queue[0][0] // BUCKET] if fold.in_bounds() else [])
        if after:
            self._timer(min(after))
        out = {k: [v] * len(found) for k, v in zip(self.keys, key)} | {"us": [x[0] for x in found], "cyc": [x[1] for x in found]}
        for i, name in enumerate(self.outs):
            out[name] = [None if x[2][i] is None else x[2][i][0] for x in found]
        # objects, as pandas' own text columns don't become one Arrow array
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})


def _cell(x):
    """(value,) of a tick, else None."""
    import pandas as pd

    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, dict):
        return (x["v"],)
    return (x["v"] if hasattr(x, "keys") else x[0],)


def merged(rows: list[tuple]) -> Iterator[tuple[int, list]]:
    """Rows (us, cells) in time order, those of one time as one; of two ticks of an input the later to arrive stays."""
    at, now = None, []
    for us, cells in sorted(rows, key=lambda r: r[0]):
        if us != at:
            if at is not None:
                yield at, now
            at, now = us, list(cells)
        else:
            now = [new if new is not None else old for old, new in zip(now, cells)]
    if at is not None:
        yield at, now


def _stream(rows: DataFrame, keys: list[str], time: str, inputs: dict[str, Column], late_after: str, folding, scalars: dict, outputs: dict[str, str]) -> DataFrame:
    ship(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late_after)
    fed = marked.select(*keys, "_t", F.unix_micros("_t").alias("us"), *(F.when(c.isNotNull(), F.struct(c.alias("v"))).alias(name) for name, c in inputs.items()))
    outs = T.StructType([*(fed.schema[k] for k in keys), T.StructField("us", T.LongType()), T.StructField("cyc", T.IntegerType()), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in outputs.items())])
    processor = processor_of(folding, scalars, keys, list(inputs), list(outputs))
    done = fed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=outs, outputMode="append", timeMode="eventtime")
    return done.select(*keys, F.timestamp_micros("us").alias("t"), "cyc", *outputs)


def stream_node(node, rows: DataFrame, keys: list[str], time: str, inputs: dict[str, Column], late_after: str, **scalars) -> DataFrame:
    """A node on a streaming DataFrame: each input is a column, null where it doesn't tick.

    Rows may be `late_after` out of order. Gives keys, t, cyc and a column for each output, one row for each cycle with an output.
    """
    return _stream(rows, keys, time, inputs, late_after, node.folding, scalars, node.outs)


def stream_graph(graph, rows: DataFrame, keys: list[str], time: str, inputs: dict[str, Column], late_after: str) -> DataFrame:
    """A graph of operators and nodes on a streaming DataFrame, all of it in one stateful step by key.

    `graph` gets an edge for each input and returns named edges; each is a column of the result, null where it didn't tick.
    """
    from ..functions.node import Circuit
    from ..operators.feedback import Loop, LoopEdge

    loop = Loop()
    outputs = graph(**{name: LoopEdge(loop, None, name) for name in inputs})
    steps, names = loop.wired({}), list(inputs)
    found = _stream(rows, keys, time, inputs, late_after, lambda: Circuit(steps, names, []), {}, loop.columns)
    shown = found.select(*keys, "t", "cyc", *(F.col(f"o{e.step}_{e.out}").alias(k) for k, e in outputs.items()))
    return shown.filter(F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(True)) for k in outputs), F.lit(False)))


def replay(spark: SparkSession, folder: str, files: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs over what is there and returns the result table, which executors write to the shared folder; nothing of it passes the driver."""
    folder = folder or f"{shared_folder(stream.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
