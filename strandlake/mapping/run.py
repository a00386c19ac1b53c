"""Read mapping as a table: every pair of a reference and a read set is a task that runs the mapper and streams its lines.

What the mappers write is stored before it is used, so they run once, and a lost executor costs the tasks it had.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import text
from .commands import ReadSet, abundance_command, mapping_command, output_lines, sample_name

LINES = 20_000


def _lines(spark: SparkSession, commands: Sequence[Callable[[str], list[str]]]) -> DataFrame:
    """(job, value): the lines of each command, a task each. A command is given a prefix for files of its own, on the machine it runs on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column(0).to_pylist():
                with tempfile.TemporaryDirectory() as scratch:
                    lines = output_lines(commands[job](f"{scratch}/parts"))
                    while part := list(islice(lines, LINES)):
                        yield pa.RecordBatch.from_arrays([pa.array([job] * len(part), pa.int32()), pa.array(part, pa.string())], names=["job", "value"])

    return spark.range(0, len(commands), 1, max(len(commands), 1)).mapInArrow(run, "job int, value string")


def reference_contigs(spark: SparkSession, references: Sequence[str]) -> DataFrame:
    """(shard, tid, contig, length) of reference FASTA files."""
    if not references:
        raise ValueError("no reference")
    return text.fasta_contigs(spark, references).withColumnRenamed("source", "shard")


def mapped(
    spark: SparkSession, mapper: str, references: Sequence[str], sets: Sequence[ReadSet], threads: int = 1, extra: str = "", contigs: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """Alignments of every read set to every reference; the reference is the ``shard``. With one reference a sample is named by it and its
    reads, ``whole`` keeps the lines, to be written; with more of them (parts of one reference) by its reads."""
    if not sets:
        raise ValueError("no reads")
    jobs = [(i, r, k, s) for i, r in enumerate(references) for k, s in enumerate(sets)]
    commands = [lambda scratch, r=r, s=s: mapping_command(mapper, r, s, threads, extra, scratch) for _, r, _, s in jobs]
    for c in commands:
        c("")  # wrong combinations are known before anything runs
    names = [(n, i, k, sample_name(r if len(references) == 1 else None, s)) for n, (i, r, k, s) in enumerate(jobs)]
    told = spark.createDataFrame(names, "job int, shard int, sample_idx int, sample string")
    rows = text.parsed_sam(_lines(spark, commands).join(F.broadcast(told), "job"), reference_contigs(spark, references) if contigs is None else contigs, ["line"] if whole else [])
    return written(rows, "mapped")


def abundances(spark: SparkSession, reference: str, sets: Sequence[ReadSet], threads: int = 1, extra: str = "") -> DataFrame:
    """(sample_idx, sample, entry_id, entry, strobealign-aemb): what the mapper's abundance mode estimates, unchanged."""
    if not sets:
        raise ValueError("no reads")
    lines = written(_lines(spark, [lambda _, s=s: abundance_command(reference, s, threads, extra) for s in sets]), "abundances")
    told = spark.createDataFrame([(k, sample_name(reference, s)) for k, s in enumerate(sets)], "job int, sample string")
    two = F.split("value", "\t")
    checked = F.when(F.size(two) == 2, two).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), "value")))
    rows = lines.select("job", checked.alias("f")).select("job", F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("double").alias("strobealign-aemb"))
    numbered = reference_contigs(spark, [reference]).select("contig", F.col("tid").cast("bigint").alias("entry_id"))
    return rows.join(numbered, "contig", "left").join(F.broadcast(told), "job").select(F.col("job").alias("sample_idx"), "sample", "entry_id", F.col("contig").alias("entry"), "strobealign-aemb")
