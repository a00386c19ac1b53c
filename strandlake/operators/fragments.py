"""Identity and aligned share of pairs of genomes, fragment by fragment.

Contigs are cut into fragments. A fragment of one genome is looked for in the other by its k-mers, of which those with the smallest hashes (one in
``SAMPLED``) are kept on both sides: the place that has most of them is a fragment of the other genome with the one behind it, as a fragment need not
begin where the other's do. If it has the share c of them, their identity is about c ** (1 / k); fragments that come out at
``LEAST_IDENTITY`` or more align. A genome is compared with the other in both directions; the identity of a pair is the larger
mean over aligned fragments, and its aligned share the larger share of fragments that align.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import K, kmer_values

FRAGMENT, SAMPLED = 3_000, 25
LEAST_IDENTITY = 0.85
#: Fragments with fewer sampled k-mers are not judged.
LEAST_SAMPLED = 16


def fragment_hashes(sequences: DataFrame, length: int = FRAGMENT, k: int = K) -> DataFrame:
    """(genome, contig, fragment, hash): the distinct sampled hashes of each fragment. ``sequences`` has genome, contig and seq, a row per contig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.uint64(np.iinfo(np.uint64).max // (2 * SAMPLED))  # a k-mer has the smaller one of two hashes
        for batch in batches:
            for genome, contig, seq in zip(*(c.to_pylist() for c in batch.columns)):
                values = kmer_values(seq or "", k)
                at = np.flatnonzero(values <= most)
                each = np.unique(np.stack([at // length, values[at].astype(np.int64)]), axis=1)
                n = each.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([genome] * n, pa.string()), pa.array([contig] * n, pa.string()), pa.array(each[0]), pa.array(each[1])], names=["genome", "contig", "fragment", "hash"])

    return sequences.select("genome", "contig", "seq").mapInArrow(run, "genome string, contig string, fragment long, hash long")


def identities(pairs: DataFrame, hashes: DataFrame, k: int = K) -> DataFrame:
    """(a, b, ani, share) of ``pairs`` (a, b); null where a pair has no fragment that can be judged. ``hashes`` is stored, as it is read more than once."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    fragment = ["contig", "fragment"]
    sizes = hashes.groupBy("genome", *fragment).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SAMPLED)
    ours = both.join(hashes.withColumnRenamed("genome", "x"), "x")
    theirs = hashes.select(F.col("genome").alias("y"), "hash", F.col("contig").alias("on"), F.col("fragment").alias("at"))
    met = ours.join(theirs, ["y", "hash"]).groupBy("x", "y", *fragment, "on", "at").agg(F.count("*").alias("c"))
    w = Window.partitionBy("x", "y", *fragment, "on").orderBy("at")
    behind = F.when(F.lead("at").over(w) == F.col("at") + 1, F.lead("c").over(w)).otherwise(0)
    best = met.withColumn("c", F.col("c") + behind).groupBy("x", "y", *fragment).agg(F.max("c").alias("c"))
    every = both.join(sizes.withColumnRenamed("genome", "x"), "x").join(best, ["x", "y", *fragment], "left")
    same = F.pow(F.least(F.coalesce("c", F.lit(0)), "n") / F.col("n"), F.lit(1 / k))
    judged = every.withColumn("same", F.when(same >= LEAST_IDENTITY, same))
    directed = judged.groupBy("x", "y").agg(F.avg("same").alias("ani"), (F.count("same") / F.count("*")).alias("share"))
    told = directed.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("ani").alias("ani"), F.max("share").alias("share"))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.join(told, ["a", "b"], "left")
