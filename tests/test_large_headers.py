"""Headers of so many contigs that they are longer than a split, and numbers that are given to many rows."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import coverage as cov
from strandlake.plans import queries
from strandlake.schema import ALIGNMENTS
from strandlake.sources import binary, files

CONTIGS = 65_600


@pytest.fixture(scope="module")
def wide_bam(spark, tmp_path_factory):
    """A file whose header, read from the end of its text on, looks like a record that ends far behind the file."""
    path = str(tmp_path_factory.mktemp("wide") / "wide.bam")
    names = F.when(F.col("id") == 0, F.lit("c0!!!!000000000000")).otherwise(F.concat(F.lit("c"), F.hex(F.xxhash64("id"))))
    contigs = spark.range(CONTIGS).select(F.col("id").cast("int").alias("tid"), names.alias("contig"), F.when(F.col("id") == CONTIGS - 1, 912_345).otherwise(5000).cast("bigint").alias("length"))
    rows = [("wide", 0, f"r{k}", 0, (k * 7) % CONTIGS, k % 900, 60, "90M", None, -1, 0, 90, 0, 90, 0) for k in range(500)]
    binary.write_bam(spark.createDataFrame(rows, ALIGNMENTS).coalesce(1), contigs, path)
    return path


def places(rows):
    return sorted((r["qname"], r["tid"], r["pos"]) for r in rows.select("qname", "tid", "pos").collect())


@pytest.mark.parametrize("known", [True, False])
def test_header_longer_than_a_split(spark, wide_bam, known):
    expected = sorted((f"r{k}", (k * 7) % CONTIGS, k % 900) for k in range(500))
    if known:
        rows, headers = binary.bam_and_headers(spark, [wide_bam], 1 << 17)
        assert headers.contigs.count() == CONTIGS
    else:
        binary.register(spark)
        rows = spark.read.format("bam").option("split_bytes", 1 << 17).load(wide_bam)
    assert places(rows) == expected


def test_numbers_of_wide_rows_have_no_gaps(spark):
    """Ranges of wide rows and of their order alone are merged differently."""
    wide = F.concat(*(F.sha2(F.concat(F.lit(f"{k}-"), "id"), 512) for k in range(4)))
    got = files.numbered(spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("v"), wide.alias("text")), F.col("v"), "n")
    assert got.agg(F.count("*"), F.countDistinct("n"), F.max("n"), F.max(F.length("text"))).first() == (40_000, 40_000, 39_999, 512)


def test_large_numbers_of_contigs(spark):
    contigs = spark.createDataFrame([(1_000_000, "a", 900), (2_000_000_000, "b", 900), (4, "c", 900)], "tid int, contig string, length bigint")
    assert sorted(r["place"] for r in queries._own_header(contigs, 2).collect()) == list(range(contigs.where("tid % 3 <> 2").count()))


def test_short_contigs_count_once_whatever_their_records(spark):
    """A contig that its ends take up counts no bases once it has a record, be they many or in several bins; ends of blocks are shuffled once."""
    contigs = spark.createDataFrame([(0, "g~a", 70_000, "g", 0), (1, "g~b", 100_000, "g", 0), (2, "g~c", 60_000, "g", 0)], "tid int, contig string, length bigint, genome string, entry_id bigint")
    rows = [("s", 0, f"r{k}", 0, tid, pos, 60, "90M", None, -1, 0, 90, 0, 90, 0) for k, (tid, pos) in enumerate([(0, 10), (0, 10), (0, 69_000), (1, 50_000), (1, 66_000)])]
    used = spark.createDataFrame(rows, ALIGNMENTS)
    o = cov.Options(end_exclusion=40_000)
    got = cov.by_genome(used, contigs, cov.samples_of(used), o).select("windowed", "reads", "mean").collect()
    assert [tuple(r) for r in got] == [(80_000, 5, 90 / 80_000)]  # 20,000 bases of b, all of c, which has no record; 90 bases of r3
    plan = cov.depth_rows(used, contigs.drop("genome"), o, ["entry_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("RepartitionByExpression") == 1
