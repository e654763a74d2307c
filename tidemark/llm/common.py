"""What the operators of this subpackage share: tables, shared folders, worker memory."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Prefix of every internal column, so that extra input columns cannot clash with one.
P = "_tm_"
#: The contract's white space: U+0020 and U+0009 to U+000D.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from `spark.checkpoint.dir`; only where all is one machine, and none is set, one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_base(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, or the folder went with it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors cost no rework."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that `written` gave; nothing for any other."""
    if hasattr(df, "_tm_path"):
        _delete(df.sparkSession, df._tm_path)


#: Rows of keys that may be broadcast, at some 60 bytes each.
BROADCAST_ROWS = 500_000


def checked(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has so few rows; else Spark shuffles both sides."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body's lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Words between the contract's white space; no words of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def worker_memory() -> types.ModuleType:
    """A module of this Python worker's process, kept from task to task."""
    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
