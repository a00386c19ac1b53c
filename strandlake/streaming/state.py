"""Tables of sums that micro-batches add to, as segments in a shared folder that are merged in levels.

A segment holds the sums of the batches from ``lo`` to ``hi``; it counts once its marker is there, which is written last. After every
``fan`` batches the newest segments become one, after every ``fan * fan`` those become one again, and so on: a row is written
once a level, and a reader adds up about ``fan`` segments a level. Segments that a merge has replaced are deleted by the next merge, so a reader
has that long to end.

A batch that is run again is left out if a whole segment has it, and replaces what a lost run left of it otherwise. As ids of batches tell what
has been added, a state belongs to one checkpoint of one stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"segment-(\d+)-(\d+)")
_MARKER = "_whole"

Segment = tuple[int, int]


class Folder:
    """What Spark's own file systems offer on a path, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, *names: str) -> bool:
        return self._fs.exists(self._at(*names))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at())] if self.exists() else []

    def mark(self, *names: str) -> None:
        self._fs.create(self._at(*names), True).close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class SummedTables:
    """``tables`` has, by name, the key columns and the columns that are summed. ``dealt`` names key columns that stored rows of a table are dealt out by before
    they are added up: for tables in which few rows of a segment or task have a key in common, so that adding up within tasks first would take
    memory for each row and leave as many."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, tuple[Sequence[str], Sequence[str]]], fan: int = 8, dealt: Mapping[str, Sequence[str]] | None = None):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark, self.folder, self.tables, self.fan = spark, Folder(spark, path), dict(tables), fan
        self.dealt = dict(dealt or {})

    def _path(self, segment: Segment, *names: str) -> str:
        return "/".join(["segment-%d-%d" % segment, *names])

    def whole(self) -> list[Segment]:
        found = [(int(m[1]), int(m[2])) for n in self.folder.names() if (m := _SEGMENT.fullmatch(n))]
        return [s for s in found if self.folder.exists(self._path(s, _MARKER))]

    def cover(self) -> list[Segment]:
        """The fewest whole segments that have every batch so far once."""
        chosen: list[Segment] = []
        for lo, hi in sorted(self.whole(), key=lambda s: (s[0], -s[1])):
            if not chosen or lo > chosen[-1][1]:
                chosen.append((lo, hi))
        return chosen

    def has(self, batch_id: int) -> bool:
        return any(lo <= batch_id <= hi for lo, hi in self.whole())

    def add(self, batch_id: int, sums: Mapping[str, DataFrame]) -> None:
        """Adds one batch, whose tables may hold a key more than once."""
        if not self.has(batch_id):
            self._write((batch_id, batch_id), {name: self._summed(name, df) for name, df in sums.items()})
        span = self.fan
        while (batch_id + 1) % (span * self.fan) == 0:
            span *= self.fan
        if (batch_id + 1) % span == 0:
            self.merge(batch_id + 1 - span, batch_id)

    def merge(self, lo: int, hi: int) -> None:
        """Makes one segment of those within ``lo`` to ``hi``; a merge that was lost on its way is made anew."""
        cover = self.cover()
        parts = [s for s in cover if lo <= s[0] and s[1] <= hi]
        for old in [s for s in self.whole() if s not in cover]:
            self.folder.delete(self._path(old))
        if len(parts) > 1:
            self._write((lo, hi), {name: self._sum_of(name, parts) for name in self.tables})

    def table(self, name: str) -> DataFrame:
        """The sums of all batches so far. The segments are those of the moment of the call."""
        return self._sum_of(name, self._some())

    def parts(self, name: str) -> DataFrame:
        """The same as sums of segments, for readers that add them up themselves: a key has a row in each segment that it is in."""
        return self._union_of(name, self._some())

    def _some(self) -> list[Segment]:
        cover = self.cover()
        if not cover:
            raise ValueError(f"{self.folder.path}: no batch has been added yet")
        return cover

    def _write(self, segment: Segment, tables: Mapping[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder.path}/{self._path(segment, name)}")
        self.folder.mark(self._path(segment, _MARKER))

    def _union_of(self, name: str, segments: Sequence[Segment]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder.path}/{self._path(s, name)}") for s in segments])

    def _sum_of(self, name: str, segments: Sequence[Segment]) -> DataFrame:
        rows = self._union_of(name, segments)
        return self._summed(name, rows.repartition(*self.dealt[name]) if name in self.dealt else rows)

    def _summed(self, name: str, df: DataFrame) -> DataFrame:
        """Rows whose sums are all 0 say nothing and go."""
        key, sums = self.tables[name]
        rows = df.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums))
        return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c) != 0, F.lit(True)) for c in sums)))
