"""Whether the records of each sample stand in the order of their contigs, without a sort over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unsorted_samples(alignments: DataFrame) -> DataFrame:
    """(sample): samples with a mapped record behind one of a later contig. ``alignments`` has file, block and at: each split is looked at on its own, and the
    first and last contig of each are compared from one to the next (a row a split). Contigs are told by ``tid``, so samples are to have
    their own header's numbers or ones in its order."""
    split = ["sample", "file", "block"]
    placed = alignments.where("tid is not null").select(*split, "at", "tid")
    back = F.coalesce(F.lag("tid").over(Window.partitionBy(*split).orderBy("at")) > F.col("tid"), F.lit(False))
    parts = placed.withColumn("back", back).groupBy(*split).agg(F.max("back").alias("back"), F.min_by("tid", "at").alias("first"), F.max_by("tid", "at").alias("last"))
    after = F.coalesce(F.lag("last").over(Window.partitionBy("sample").orderBy("file", "block")) > F.col("first"), F.lit(False))
    return parts.withColumn("back", F.col("back") | after).where("back").select("sample").distinct()


def check_sorted(alignments: DataFrame) -> None:
    """Raise ValueError if a sample is not sorted."""
    first = unsorted_samples(alignments).orderBy("sample").limit(5).collect()
    if first:
        raise ValueError(f"BAM file appears to be unsorted: {', '.join(r['sample'] for r in first)}. Input must be sorted by reference")
