"""Reads mapped to parts of a reference on their own: each pair goes to the part where it aligns best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FIRST, PAIRED, SECONDARY, SUPPLEMENTARY, UNMAPPED
from .filters import has


def merged_contigs(contigs: DataFrame) -> DataFrame:
    """(shard, old_tid, tid, contig, length): the contigs of all shards one after the other."""
    last = contigs.groupBy("shard").agg((F.max("tid") + 1).alias("n"))
    offset = last.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return contigs.join(F.broadcast(offset), "shard").select("shard", F.col("tid").alias("old_tid"), (F.col("tid") + F.col("offset")).cast("int").alias("tid"), "contig", "length")


def excluded_contigs(contigs: DataFrame, names: DataFrame, separator: str | None = "~") -> DataFrame:
    """The contigs of excluded genomes (names: genome), by separator or by a ``genome`` column."""
    genome = F.substring_index("contig", separator, 1) if separator else F.col("genome")
    return contigs.withColumn("genome", genome).join(names.select("genome").where("genome <> ''"), "genome", "left_semi")


def best_shard(alignments: DataFrame, contigs: DataFrame, excluded: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """For each pair the records of one shard, with contigs numbered over all shards.

    The score of a pair in a shard is the sum of the alignment scores of its mates, 0 for an unmapped one. Shards in
    which the first mate lies on an excluded contig do not take part. Ties go by a seeded hash.
    """
    primary = alignments.where(has(PAIRED) & ~has(SECONDARY) & ~has(SUPPLEMENTARY))
    merged = merged_contigs(contigs)
    rows = primary
    if excluded is not None:
        bad = excluded.select(F.col("shard").alias("x_shard"), F.col("tid").alias("x_tid"))
        rows = rows.join(bad, (F.col("shard") == F.col("x_shard")) & (F.col("tid") == F.col("x_tid")), "left").withColumn("_bad", has(FIRST) & F.col("x_tid").isNotNull()).drop("x_shard", "x_tid")
    else:
        rows = rows.withColumn("_bad", F.lit(False))
    points = F.when(has(UNMAPPED), F.lit(0)).otherwise(F.coalesce("align_score", F.lit(0)))
    pair = ["sample_idx", "qname"]
    scored = rows.groupBy(*pair, "shard").agg(F.sum(points).alias("_score"), F.max("_bad").alias("_out")).where("not _out")
    best = F.max_by("shard", F.struct("_score", F.xxhash64("qname", "shard", F.lit(seed)))).alias("shard")
    chosen = scored.groupBy(*pair).agg(best)
    placed = rows.join(chosen, [*pair, "shard"], "left_semi").drop("_bad")
    to = merged.select("shard", F.col("old_tid").alias("tid"), F.col("tid").alias("new_tid"))
    return placed.join(to, ["shard", "tid"], "left").withColumn("tid", F.col("new_tid")).drop("new_tid").select(*alignments.columns)
