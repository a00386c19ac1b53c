"""A folder that the driver and all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that is not in use yet, under ``spark.checkpoint.dir``. Only a session within one process may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="strandlake-"))
        root = f"file://{_LOCAL_ROOT[0]}"
    return f"{root.rstrip('/')}/strandlake-{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run within are deleted once it has ended, and not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, stored as Parquet and read again: what made it is not run again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_let_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
