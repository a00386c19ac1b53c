"""Coverage, and counts by windows of event time, kept up to date as rows arrive.

Changes of depth, read counts and counts of windows add up, so each micro-batch sends its sums by key and the state
is their running total (``state.SummedTables``); statistics are computed from it at any time. Rows that come late are added to where they belong,
however late they are; only ``windowed_events`` drops what its watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import record_counts
from ..operators.depth import BIN, COUNTS, changes, runs_of
from ..operators.filters import Flags, flag_filter
from .state import Folder, SummedTables


def _started(state: SummedTables, add, stream: DataFrame, checkpoint: str):
    if state.whole() and not Folder(state.spark, checkpoint).exists():
        raise ValueError(f"{state.folder.path} has batches of another stream: there is no checkpoint {checkpoint}")
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


class CoverageState:
    """Depth changes and read counts of all alignments of a stream."""

    def __init__(self, path: str, contigs: DataFrame, flags: Flags = Flags(), fan: int = 8):
        self.contigs, self.flags = contigs, flags
        tables = {"deltas": (["sample_idx", "tid", "length", "bin", "pos"], ["delta"]), "counts": (["sample_idx", "tid"], COUNTS)}
        self.sums = SummedTables(contigs.sparkSession, path, tables, fan, {"deltas": ["sample_idx", "tid", "bin"]})

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. What records change is added up by the state, once."""
        used = flag_filter(batch, self.flags)
        self.sums.add(batch_id, {"deltas": changes(used, self.contigs, BIN), "counts": record_counts(used)})

    def start(self, stream: DataFrame, checkpoint: str):
        return _started(self.sums, self.add, stream, checkpoint)

    def segments(self) -> DataFrame:
        """As ``depth.segments`` of all alignments so far."""
        return runs_of(self.sums.parts("deltas"))

    def counts(self) -> DataFrame:
        """As ``coverage.contig_counts`` of all alignments so far."""
        return self.sums.table("counts")


class WindowState:
    """Counts and totals of events (ts, event_type, value) by type in tumbling windows of event time, whole whatever the order of arrival."""

    def __init__(self, spark: SparkSession, path: str, width: str = "5 minutes", fan: int = 8):
        self.width = width
        self.sums = SummedTables(spark, path, {"windows": (["start", "event_type"], ["n", "total"])}, fan)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Events without a time are in no window."""
        start = F.window("ts", self.width)["start"].alias("start")
        rows = batch.where("ts is not null").groupBy(start, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28, 6)")).alias("total"))
        self.sums.add(batch_id, {"windows": rows})

    def start(self, stream: DataFrame, checkpoint: str):
        return _started(self.sums, self.add, stream, checkpoint)

    def windows(self) -> DataFrame:
        """(start, event_type, n, total) of all events so far."""
        return self.sums.table("windows")


def running_counts(alignments: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """Read counts by sample and contig of a stream, for update or complete mode."""
    return flag_filter(alignments, flags).groupBy("sample_idx", "tid").agg(F.count("*").alias("n"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of events by type in tumbling windows; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
