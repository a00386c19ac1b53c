"""Second-stage metrics, which relate an entry to its sample: RPKM, TPM and relative abundance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def normalised(stats: DataFrame, totals: DataFrame, exact: bool = False, divide_first: bool = False) -> DataFrame:
    """``stats`` with rpkm, tpm and relative_abundance made final. ``totals`` has the reads and sums of each sample.

    ``divide_first`` is the order of operations of the dense table, otherwise that of the sparse one; in 32 bits they may
    differ in the last digit. A sample whose coverages are all 0 has NaN abundances.
    """
    kind = "float" if exact else "double"
    rows = stats.join(totals.select("sample_idx", "num_reads", "num_mapped", F.col("sum_tpm").alias("_tpm"), F.col("sum_mean").cast(kind).alias("_mean")), "sample_idx")
    share = ratio(F.col("num_mapped"), F.col("num_reads"), exact)
    a, nan = F.col("relative_abundance").cast(kind), F.lit(float("nan")).cast(kind)
    hundred = F.lit(100.0).cast(kind)
    if divide_first:
        part = F.try_divide(a, F.col("_mean")).cast(kind)
        relative = ((part * hundred).cast(kind) * share).cast(kind) if not exact else ((part * share).cast(kind) * hundred).cast(kind)
    else:
        relative = F.try_divide(((a * hundred).cast(kind) * share).cast(kind), F.col("_mean")).cast(kind)
    return rows.select(
        *(c for c in stats.columns if c not in ("rpkm", "tpm", "relative_abundance")),
        ratio(F.col("rpkm"), F.col("num_mapped"), exact).alias("rpkm"),
        F.when(F.col("_tpm") == 0, F.lit(0.0)).otherwise(F.try_divide("tpm", "_tpm") * 1_000_000).cast(kind).alias("tpm"),
        F.when((F.col("_mean") == 0) | (F.col("num_reads") == 0), nan).otherwise(relative).alias("relative_abundance"),
    )


def unmapped(totals: DataFrame, exact: bool = False) -> DataFrame:
    """(sample_idx, sample, entry "unmapped", relative_abundance): the share of reads that are in no reported entry."""
    kind = "float" if exact else "double"
    share = ratio(F.col("num_mapped"), F.col("num_reads"), exact)
    left = (F.lit(100.0).cast(kind) * (F.lit(1.0).cast(kind) - share).cast(kind)).cast(kind)
    return totals.select("sample_idx", "sample", F.lit("unmapped").alias("entry"), F.when(F.col("num_reads") == 0, F.lit(float("nan")).cast(kind)).otherwise(left).alias("relative_abundance"))
