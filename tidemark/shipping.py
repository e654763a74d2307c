"""What driver and executors share: the package's sources, which a node's body may name, and a folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from weakref import WeakSet

from pyspark.sql import SparkSession

_shipped: WeakSet = WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once for each context.

    The archive is made in the context's own scratch folder on the driver; executors get it from the driver.
    """
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    package = os.path.basename(root)
    path = os.path.join(sc._temp_dir, f"{package}-sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(package, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from `spark.checkpoint.dir`. Only where all is one machine, and none is set, one of its own."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_:
        return set_.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")
