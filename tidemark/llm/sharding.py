"""Sharding by fixed virtual slots, with DataFrame operations only.

Records hash into thousands of slots that never change. Bytes and rows are summed for each slot before
anything is placed, and a versioned map says which shard a slot lives in. A new map puts the largest
slots first, each in the least full shard; rebalancing edits the last version, moving only what it must.
The map has one row for each slot, so it is small by construction and may be broadcast; records are
numbered within runs of a slot, and a run's first place in its shard is summed before, so that no task
holds a shard, nor all records of one doc_id.

The newest map of a folder is edited, never replaced: a second call for the same folder, with other records or another
number of shards, writes the next version and moves only the slots that it must.

Defined results: a null text has no bytes (size 1, crc32 0); a very long one counts whole; an empty table gives no rows;
equal doc_ids, null ones too, share a slot, and within it are numbered by the text's crc32 and the size; repeated rows have
places of their own; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import P, shared_path, written

SLOTS = 8192
#: Runs that a slot's records are numbered in, by a hash of the text.
RUNS = 16


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot; every edit is a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def new(sizes: list[int], shards: int) -> SlotMap:
        """Largest slots first, each in the least full shard."""
        full, shard_of = [(0, s) for s in range(shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, s = heapq.heappop(full)
            shard_of[slot] = s
            heapq.heappush(full, (load + sizes[slot], s))
        return SlotMap(1, shards, tuple(shard_of))

    def rebalanced(self, sizes: list[int], shards: int, slack: float = 0.001) -> SlotMap:
        """The next version, for `shards` shards: slots of shards that went away, and then the largest slots that fit from
        shards over the mean, move to the least full shard; all others stay."""
        shard_of, loads = list(self.shard_of), [0] * shards
        own: list[list[int]] = [[] for _ in range(shards)]
        homeless = []
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            if shard_of[slot] < shards:
                loads[shard_of[slot]] += sizes[slot]
                own[shard_of[slot]].append(slot)
            else:
                homeless.append(slot)
        mean = sum(sizes) / shards
        for s in range(shards):
            kept = []
            for slot in own[s]:
                if loads[s] > mean * (1 + slack) and sizes[slot] <= loads[s] - mean:
                    loads[s] -= sizes[slot]
                    homeless.append(slot)
                else:
                    kept.append(slot)
            own[s] = kept
        full = [(n, s) for s, n in enumerate(loads)]
        heapq.heapify(full)
        for slot in sorted(homeless, key=lambda i: (-sizes[i], i)):
            load, s = heapq.heappop(full)
            shard_of[slot] = s
            heapq.heappush(full, (load + sizes[slot], s))
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def bases(self, rows: list[int]) -> list[int]:
        """Of each slot the first place in its shard, where slots have so many rows."""
        base, next_place = [], [0] * self.shards
        for slot, s in enumerate(self.shard_of):
            base.append(next_place[s])
            next_place[s] += rows[slot]
        return base

    def save(self, spark: SparkSession, folder: str, rows: list[int]) -> str:
        """Stores this version, for slots of so many rows, beside the others and returns its path."""
        path = f"{folder}/version={self.version}"
        listed = [(slot, s, base, n, self.shards) for slot, (s, base, n) in enumerate(zip(self.shard_of, self.bases(rows), rows, strict=True))]
        spark.createDataFrame(listed, f"{P}slot int, {P}shard int, {P}base long, {P}rows long, {P}shards int").coalesce(1).write.parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").orderBy(f"{P}slot").collect()
        return SlotMap(version, rows[0][f"{P}shards"], tuple(r[f"{P}shard"] for r in rows))

    @staticmethod
    def newest(spark: SparkSession, folder: str) -> SlotMap | None:
        """The last version that was stored whole; None where there is none."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")) if files.exists(path) else None
        versions = [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]
        return SlotMap.load(spark, folder, max(versions)) if versions else None


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and slot, without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias(f"{P}slot"))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; as many numbers as slots, whatever the input."""
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy(f"{P}slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r[f"{P}slot"]], rows[r[f"{P}slot"]] = r["size"], r["n"]
    return sizes, rows


def edited(spark: SparkSession, folder: str, sizes: list[int], shards: int) -> SlotMap:
    """The next map of a folder for slots of these sizes: the newest rebalanced, or the first. Not stored yet."""
    last = SlotMap.newest(spark, folder)
    return SlotMap.new(sizes, shards) if last is None else last.rebalanced(sizes, shards)


def placed(records: DataFrame, path: str) -> DataFrame:
    """Sized records with shard, slot (the row's place in its shard) and virtual_slot, by a stored map."""
    run, n = f"{P}run", f"{P}n"
    dealt = records.withColumn(run, F.pmod("text_crc32", F.lit(RUNS)).cast("int"))
    runs = dealt.groupBy(f"{P}slot", run).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(f"{P}slot").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    # slots times runs, whatever the input; joined by the keys that the rows are numbered by
    starts = runs.withColumn(f"{P}before", before).drop(n)
    within = Window.partitionBy(f"{P}slot", run).orderBy("doc_id", "text_crc32", "size")
    found = dealt.withColumn(n, F.row_number().over(within) - 1).join(starts, [f"{P}slot", run]).join(F.broadcast(records.sparkSession.read.parquet(path).drop(f"{P}rows")), f"{P}slot")
    return found.select("doc_id", "size", "text_crc32", F.col(f"{P}shard").alias("shard"), (F.col(f"{P}base") + F.col(f"{P}before") + F.col(n)).alias("slot"), F.col(f"{P}slot").alias("virtual_slot"))


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the row's place in its shard) and virtual_slot, by the next version of the map in `folder`."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "slot-map")
    records = written(sized(docs, slots), "sized")
    sizes, rows = slot_totals(records, slots)
    return placed(records, edited(spark, folder, sizes, shards).save(spark, folder, rows))


def resharded(docs: DataFrame, before: int, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """The same after an edit: the records' first map is for `before` shards, and its next version, for `shards`, places them."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "slot-map")
    records = written(sized(docs, slots), "sized")
    sizes, rows = slot_totals(records, slots)
    edited(spark, folder, sizes, before).save(spark, folder, rows)
    return placed(records, edited(spark, folder, sizes, shards).save(spark, folder, rows))
