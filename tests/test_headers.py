"""Samples whose headers differ, and many files in one scan."""

import time

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import coverage as cov
from strandlake.plans import queries, testbed
from strandlake.sources import binary, files, text


def sam(path, contigs, reads, text_of="100M"):
    """A SAM file: ``contigs`` as (name, length) and ``reads`` as (contig, how many)."""
    lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{x}" for n, x in contigs)]
    for name, count in reads:
        lines += [f"{name}-{k}\t0\t{name}\t{200 + k}\t60\t{text_of}\t*\t0\t0\t*\t*\tNM:i:0" for k in range(count)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def three(tmp_path):
    return [
        sam(tmp_path / "a.sam", [("c1", 1000), ("c2", 900)], [("c1", 5), ("c2", 2)]),
        sam(tmp_path / "b.sam", [("z9", 800), ("c1", 1000)], [("z9", 7), ("c1", 1)]),
        sam(tmp_path / "c.sam", [("c2", 900), ("c1", 1000)], [("c2", 4)]),
    ]


def as_bam(spark, paths, folder):
    out = []
    for p in paths:
        path = str(folder / (text.stem(p) + ".bam"))
        binary.write_bam(text.sam(spark, p), text.sam_contigs(spark, p), path)
        out.append(path)
    return out


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_entries_are_aligned_by_name(spark, three, tmp_path, kind):
    paths = three if kind == "sam" else as_bam(spark, three, tmp_path)
    out = tmp_path / "out.tsv"
    cli.main(["contig", "-b", *paths, "-m", "count", "-o", str(out)], spark)
    assert out.read_text().splitlines() == ["Contig\ta Read Count\tb Read Count\tc Read Count", "c1\t5\t1\t0", "c2\t2\t0\t4", "z9\t0\t7\t0"]
    cli.main(["contig", "-b", *paths, "-m", "count", "length", "--output-format", "sparse", "-o", str(out)], spark)
    # A sample has rows for the contigs of its own header.
    assert [tuple(x.split("\t")[:2]) for x in out.read_text().splitlines()[1:]] == [("a", "c1"), ("a", "c2"), ("b", "c1"), ("b", "z9"), ("c", "c1"), ("c", "c2")]


def test_genomes_have_the_contigs_of_the_own_header(spark, tmp_path):
    paths = [sam(tmp_path / "a.sam", [("g~1", 1000), ("g~2", 500)], [("g~1", 3)]), sam(tmp_path / "b.sam", [("h~1", 700), ("g~2", 500)], [("g~2", 1), ("h~1", 2)])]
    alns, headers = text.sam_and_headers(spark, paths)
    samples = headers.samples(cov.samples_of(alns))
    stats = cov.by_genome(alns, cov.contigs_by_separator(headers.contigs), samples, mode="separator", trimmed=False)
    assert {(r["sample_idx"], r["entry"]): (r["length"], r["count"]) for r in stats.collect()} == {(0, "g"): (1500, 3), (1, "g"): (500, 1), (1, "h"): (700, 2)}


def test_two_lengths_of_a_contig_are_an_error(spark, tmp_path):
    paths = [sam(tmp_path / "a.sam", [("c1", 1000)], []), sam(tmp_path / "b.sam", [("c1", 999), ("d", 5)], [])]
    with pytest.raises(Exception, match="two lengths"):
        text.sam_and_headers(spark, paths)


def test_equal_headers_are_one(spark, three):
    _, headers = text.sam_and_headers(spark, [three[0]])
    assert headers.places is None and [tuple(r) for r in headers.contigs.orderBy("tid").collect()] == [(0, "c1", 1000), (1, "c2", 900)]


def test_many_files_are_one_scan(spark, tmp_path):
    paths = []
    for k in range(2000):
        p = tmp_path / f"g {k}.fna"
        p.write_text(f">x{k} first\nACGT\nAC\n>y{k}\nGG\n")
        paths.append(str(p))
    began = time.time()
    genomes = text.genomes_from_fasta(spark, paths)
    assert genomes._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert time.time() - began < 30
    rows = genomes.collect()
    assert len(rows) == 4000 and {(r["genome_idx"], r["genome"], r["contig"]) for r in rows} == {(k, f"g {k}", f"{c}{k}") for k in range(2000) for c in "xy"}
    told = text.fasta_contigs(spark, paths[:300]).collect()
    assert {(r["source"], r["tid"], r["contig"], r["length"]) for r in told} == {(k, i, f"{c}{k}", n) for k in range(300) for i, c, n in ((0, "x", 6), (1, "y", 2))}


def test_paths_and_folders(spark, tmp_path):
    (tmp_path / "fold er").mkdir()
    for name, lines in (("a+b%20.txt", "1\n2\n"), ("fold er/part-1", "5\n"), ("fold er/part-0", "3\n4\n")):
        (tmp_path / name).write_text(lines)
    rows = files.ranked(files.scan(spark, [str(tmp_path / "fold er"), f"file://{tmp_path}/a+b%20.txt".replace("%", "%")]), "n").collect()
    assert {(r["source"], r["n"], r["value"]) for r in rows} == {(0, 0, "3"), (0, 1, "4"), (0, 2, "5"), (1, 0, "1"), (1, 1, "2")}
    with pytest.raises(ValueError):
        files.scan(spark, [str(tmp_path / "fold er"), str(tmp_path / "fold er") + "/"])


def test_numbered_in_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("v"))
    got = files.numbered(rows, F.col("v"), "n").collect()
    assert len(got) == 5000 and all(r["v"] == r["n"] for r in got)


def test_a_header_is_written_in_parts(spark):
    """A header is sorted by ranges that are files of their own: no task has all of it, and its order is that of the files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = queries._sam_files(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = files.scan(spark, paths).where(F.col("value").startswith("@SQ\t"))
    assert min(r["n"] for r in lines.groupBy("source").agg(F.countDistinct("file").alias("n")).collect()) > 1
    want = [(r["contig"], r["length"]) for r in testbed.contigs(spark, "/root/testdata/sf0.001").orderBy("tid").collect()]
    got = text.sam_headers(spark, paths).orderBy("sample_idx", "place").collect()
    assert [(r["contig"], r["length"]) for r in got] == 3 * want
    assert [r["place"] for r in got] == 3 * [*range(len(want))]
