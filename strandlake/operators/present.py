"""Shapes of results: long, one row per sample and entry (sparse), entry by sample matrix (dense), and depth tables for binning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plain_text
from .coverage import METHODS


def long(stats: DataFrame, methods: list[str]) -> DataFrame:
    """(sample_idx, entry_id, entry, method, value)."""
    each = F.array(*(F.struct(F.lit(i).alias("method_idx"), F.lit(m).alias("method"), F.col(m).cast("double").alias("value")) for i, m in enumerate(methods)))
    return stats.select("sample_idx", "entry_id", "entry", F.inline(each))


def sparse(stats: DataFrame, totals: DataFrame, methods: list[str], entry: str = "Contig", as_text: bool = False) -> DataFrame:
    """Sample, entry and a column per method, ordered by sample and entry."""
    rows = stats.join(totals.select("sample_idx", "sample"), "sample_idx").orderBy("sample_idx", "entry_id")
    shown = plain_text if as_text else (lambda c: c)
    return rows.select(F.col("sample").alias("Sample"), F.rtrim("entry", F.lit("\r")).alias(entry), *(shown(F.col(m)).alias(METHODS[m]) for m in methods))


def dense(stats: DataFrame, samples: list[tuple[int, str]], methods: list[str], entry: str = "Contig", as_text: bool = False) -> DataFrame:
    """A row per entry and a column per sample and method; what a sample lacks is 0. ``samples``: (index, name) in order."""
    shown = [(f"v{k}", f"{name} {METHODS[m]}", i, m) for k, ((i, name), m) in enumerate((s, m) for s in samples for m in methods)]  # headings may be equal
    wide = stats.groupBy("entry_id", "entry").agg(*(F.max(F.when(F.col("sample_idx") == i, F.col(m))).alias(v) for v, _, i, m in shown)).orderBy("entry_id")
    blank = F.when(F.col("entry") == "unmapped", F.lit("NA")).otherwise(F.lit("0"))
    kept = [F.coalesce(plain_text(F.col(v)), blank) if as_text else F.coalesce(F.col(v), F.lit(0.0)) for v, *_ in shown]
    return wide.select(F.rtrim("entry", F.lit("\r")).alias(entry), *(c.alias(heading) for c, (_, heading, *_) in zip(kept, shown)))


def metabat(stats: DataFrame, samples: list[tuple[int, str]]) -> DataFrame:
    """contigName, contigLen, totalAvgDepth (the mean over samples) and for each sample its mean and variance, to 4 places."""
    four = lambda c: F.round(F.coalesce(c, F.lit(0.0)).cast("double"), 4)
    cols = []
    for i, name in samples:
        own = F.col("sample_idx") == i
        cols += [four(F.max(F.when(own, F.col("mean")))).alias(f"{name}.bam"), four(F.max(F.when(own, F.col("variance")))).alias(f"{name}.bam-var")]
    wide = stats.groupBy("entry_id", "entry").agg(F.max("length").cast("bigint").alias("contigLen"), (F.sum(F.col("mean").cast("double")) / max(len(samples), 1)).alias("all"), *cols).orderBy("entry_id")
    return wide.select(F.col("entry").alias("contigName"), "contigLen", F.round("all", 4).alias("totalAvgDepth"), *(F.col(f"`{c}`") for n in samples for c in (f"{n[1]}.bam", f"{n[1]}.bam-var")))
