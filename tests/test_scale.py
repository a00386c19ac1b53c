"""Long CIGARs, deep places with many genes, and large depths: right, and without work that grows with a product or a square."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake import schema
from strandlake.functions import cigar
from strandlake.operators import coverage as cov
from strandlake.operators import genes
from strandlake.operators.coverage import Options


def by_steps(text, pos):
    at, out, aligned, n = pos, [], 0, ""
    for c in text:
        if c.isdigit():
            n += c
            continue
        if c in "M=X":
            out.append((at, at + int(n)))
        at += int(n) if c in "M=XDN" else 0
        aligned += int(n) if c in "M=XDI" else 0
        n = ""
    return at, out, aligned


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 511, 512, 513, 3000])
def test_walk_of_any_length(spark, size):
    rng = random.Random(size)
    text = "".join(f"{rng.randrange(1, 300)}{rng.choice('MIDNSHP=X')}" for _ in range(size)) or "*"
    r = spark.createDataFrame([(text, 7)], "c string, p long").select(cigar.walked(F.col("c"), F.col("p")).alias("w")).first()["w"]
    assert (r["at"], [tuple(b) for b in r["out"]], r["aligned"]) == by_steps(text, 7)


def test_walk_of_a_very_long_cigar(spark):
    text = "1M1D" * 100_000
    df = spark.createDataFrame([(text, 0)], "c string, p long")
    began = time.time()
    r = df.select(cigar.walked(F.col("c"), F.col("p")).alias("w")).select("w.at", F.size("w.out").alias("n"), "w.aligned").first()
    assert tuple(r) == (200_000, 100_000, 200_000) and time.time() - began < 60


def test_reads_within_by_brute_force(spark):
    rng = random.Random(3)
    reads = [(rng.randrange(2), rng.randrange(2), rng.randrange(300), rng.random()) for _ in range(500)]
    places = []
    for k in range(200):
        start = rng.randrange(300)
        places.append((rng.randrange(2), k, rng.randrange(3), start, start + rng.randrange(1, 120)))
    got = genes.reads_within(spark.createDataFrame(reads, "sample_idx int, tid int, pos long, same double"), spark.createDataFrame(places, "sample_idx int, entry_id int, tid int, start long, end long"), bin_size=32)
    want = {}
    for s, k, t, a, b in places:
        inside = [x for i, j, p, x in reads if (i, j) == (s, t) and a <= p < b]
        if inside:
            want[s, k] = (len(inside), round(sum(inside), 9))
    assert {(r["sample_idx"], r["entry_id"]): (r["reads"], round(r["identity"], 9)) for r in got.collect()} == want


def test_deep_places_with_many_genes(spark):
    """A million reads and ten thousand genes in one bin: ten thousand million pairs, of which none is a row."""
    reads = spark.range(0, 1_000_000).select(F.lit(0).alias("sample_idx"), F.lit(0).alias("tid"), (F.col("id") % 5000).alias("pos"), F.lit(1.0).alias("same"))
    places = spark.range(0, 10_000).select(F.lit(0).alias("sample_idx"), F.col("id").alias("entry_id"), F.lit(0).alias("tid"), (F.col("id") % 1000).alias("start"), (F.col("id") % 1000 + 3000).alias("end"))
    began = time.time()
    got = genes.reads_within(reads, places).agg(F.count("*").alias("n"), F.min("reads").alias("a"), F.max("reads").alias("b")).first()
    assert tuple(got) == (10_000, 600_000, 600_000) and time.time() - began < 90


def test_histogram_of_a_large_depth(spark):
    row = ("s", 0, "r", 0, 0, 100, 60, "100M", 0, 0, 0, 100, 0, 0, 0)
    alns = spark.createDataFrame([row], schema.ALIGNMENTS).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k")
    contigs = spark.createDataFrame([(0, "c", 1000)], schema.CONTIGS)
    got = cov.histogram(alns, contigs, cov.samples_of(alns), Options()).orderBy("depth").collect()
    assert [r["depth"] for r in got] == [*range(20_001)] and {(r["depth"], r["n_bases"]) for r in got if r["n_bases"]} == {(0, 750), (20_000, 100)}
