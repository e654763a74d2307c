"""The first example of README.md as a script of its own, with the package on the driver's path only: batch, feedback and a stream."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BEFORE = """
import os, sys
sys.path.insert(0, {root!r})
from datetime import datetime
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
rows = [("a", datetime(2024, 1, 1, 1), 1.0, 2.0), ("a", datetime(2024, 1, 1, 2), 4.0, 1.0), ("b", datetime(2024, 1, 1, 1), 3.0, 3.0)]
trades = spark.createDataFrame(rows, "symbol string, time timestamp, price double, qty double")
"""
AFTER = """
print("BATCH", sorted((r.symbol, r.value) for r in result["vwap"].collect()), sorted((r.symbol, r.value) for r in result["mean"].collect()))

@tm.node(returns="double")
def halved(x: tm.ts[float], back: tm.ts[float]):
    v = back.value if tm.ticked(back) else x.value
    return v / 2 if v > 1 else None

def looped(trades):
    loop = tm.feedback("double")
    out = halved(tm.read_frame(trades, "time", ["price"], keys=("symbol",))["price"], loop.out())
    loop.bind(out)
    tm.add_graph_output("half", out.series)

found = tm.run(looped, trades, starttime=datetime(2024, 1, 1), endtime=timedelta(days=1), spark=spark)
print("LOOP", sorted((r.symbol, r.value) for r in found["half"].collect()))

folder = sys.argv[1]
trades.write.parquet(folder + "/rows")
spark.createDataFrame([("end", datetime(2200, 1, 1), 0.0, 1.0)], trades.schema).write.parquet(folder + "/end")
from tidemark.streaming.stateful import run_available
read = lambda name: spark.readStream.schema(trades.schema).parquet(folder + "/" + name)
stream = tm.stream_node(vwap, read("rows").unionByName(read("end")), ["symbol"], "time", {"price": F.col("price"), "qty": F.col("qty")}, "0 seconds")
print("STREAM", sorted((r.symbol, r.out) for r in run_available(stream, "vwap").filter("symbol <> 'end'").collect()))
"""


def test_example_of_the_readme(tmp_path):
    with open(f"{ROOT}/README.md") as f:
        example = re.search(r"```python\n(.*?)```", f.read(), re.S)[1]
    script = tmp_path / "example.py"
    script.write_text(BEFORE.format(root=ROOT) + example + AFTER)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(tmp_path / "data")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    said = dict(line.split(" ", 1) for line in done.stdout.splitlines() if line.split(" ")[0] in ("BATCH", "LOOP", "STREAM"))
    assert said["BATCH"] == "[('a', 1.0), ('a', 2.0), ('b', 3.0)] [('a', 1.0), ('a', 4.0), ('b', 3.0)]"
    assert said["LOOP"] == "[('a', 1.0), ('a', 2.0), ('b', 0.75), ('b', 1.5)]"
    assert said["STREAM"] == "[('a', 1.0), ('a', 2.0), ('b', 3.0)]"
