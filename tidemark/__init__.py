"""Time-series and event-stream analytics on Spark DataFrames."""

from .functions import stats
from .functions.node import Outputs, alarm_value, alarmed, graph, node, now, output, schedule_alarm, starting, state, ticked, ts, valid
from .model import Frame, Series, align, series_of
from .operators.basic import apply, binary, count, cumulative, delay, difference, filter, firstN, merge, sample, split
from .operators.dynamic import dynamic
from .operators.feedback import Feedback, feedback
from .plans import profiler
from .plans.benchmarks import micro_batch_latency, producer_benchmark, throughput
from .plans.run import Stepper, begin, run
from .plans.viz import graph_to_dot, graph_to_mermaid, show_graph
from .sinks.tables import add_graph_output, format_time, print_node, schedule_on_engine_stop, to_long, to_wide, write_csv, write_parquet
from .sources.batch import AdapterManager, CsvAdapterManager, ReplayAdapterManager, const, curve, curve_from_frame, read_csv, read_frame, read_parquet, timer
from .streaming.live import FolderBroker, GenericPushAdapter, KafkaAdapterManager, NativePushAdapter
from .streaming.stateful import stream_graph, stream_node

Edge = Series
print = print_node  # noqa: A001

__all__ = [
    "AdapterManager", "CsvAdapterManager", "Edge", "Feedback", "FolderBroker", "Frame", "GenericPushAdapter", "KafkaAdapterManager", "NativePushAdapter", "Outputs", "ReplayAdapterManager", "Series", "Stepper",
    "add_graph_output", "alarm_value", "alarmed", "align", "apply", "begin", "binary", "const", "count", "cumulative", "curve", "curve_from_frame", "delay", "difference", "dynamic", "feedback", "filter", "firstN", "format_time",
    "graph", "graph_to_dot", "graph_to_mermaid", "merge", "micro_batch_latency", "node", "now", "output", "print", "print_node", "producer_benchmark", "profiler", "read_csv", "read_frame", "read_parquet",
    "run", "sample", "schedule_alarm", "schedule_on_engine_stop", "series_of", "show_graph", "split", "starting", "state", "stats", "stream_graph", "stream_node", "throughput", "ticked", "timer", "to_long", "to_wide",
    "ts", "valid", "write_csv", "write_parquet",
]
