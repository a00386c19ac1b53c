import math
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from strandlake import schema
from strandlake.functions.cigar import blocks
from strandlake.functions.numeric import percentage, plain_text
from strandlake.operators import coverage as cov
from strandlake.operators import depth, genes, normalise, present
from strandlake.operators.coverage import Options
from strandlake.operators.filters import Flags, Thresholds, pair_filter, single_filter, usable
from strandlake.sources import binary, text


@pytest.fixture
def sample(spark, tmp_path):
    path = fx.sam(tmp_path / "sample.sam")
    return text.sam(spark, path), text.sam_contigs(spark, path)


def _one(stats, entry, *metrics):
    r = stats.where(F.col("entry") == entry).first()
    return [float(r[m]) for m in metrics]


def aln(spark, rows):
    full = [("s", 0, q, f, t, p, mq, c, t, 0, 0, sl, nm, 0, 0) for q, f, t, p, mq, c, sl, nm in rows]
    return spark.createDataFrame(full, schema.ALIGNMENTS)


@pytest.mark.parametrize("cigar,pos,want", [("4M1D145M", 10, [(10, 14), (15, 160)]), ("5S10M2I3M", 0, [(0, 10), (10, 13)]), ("3M5N2=1X", 7, [(7, 10), (15, 17), (17, 18)]), ("*", 0, [])])
def test_blocks(spark, cigar, pos, want):
    got = spark.range(1).select(blocks(F.lit(cigar), F.lit(pos)).alias("b")).first()["b"]
    assert [(x["s"], x["e"]) for x in got] == want


@pytest.mark.parametrize("mapq,proper", [(255, False), (51, False), (51, True)])
def test_sam_means(spark, sample, mapq, proper):
    alns, contigs = sample
    flags = Flags(improper=not proper)
    # A threshold of quality alone is one of single reads, or of pairs too if only proper ones count.
    kept = usable(alns, Thresholds(mapq=mapq), flags)
    want = fx.used(0 if mapq == 255 else mapq, proper)
    if proper:
        names = [r[0] for r in want]
        want = [r for r in want if names.count(r[0]) == 2]
    stats = {r["entry"]: r for r in cov.by_contig(kept, contigs, cov.samples_of(alns), Options(exact=True)).collect()}
    assert set(stats) == {n for n, _ in fx.CONTIGS}
    for name, length in fx.CONTIGS:
        d, all_, r = fx.inner(name, want), fx.depths(name, want), stats[name]
        reads = [x for x in want if x[2] == name and not x[1] & 2048]
        assert math.isclose(r["mean"], sum(d) / len(d) if d else 0, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(r["covered_fraction"], sum(x > 0 for x in all_) / length, rel_tol=1e-6)
        assert math.isclose(r["variance"], fx.variance(d), rel_tol=1e-5, abs_tol=1e-7) and r["covered_bases"] == sum(x > 0 for x in all_)
        assert r["count"] == len(reads) and math.isclose(r["anir"], sum(map(fx.identity, reads)) / len(reads) if reads else 0, rel_tol=1e-6)
        assert math.isclose(r["trimmed_mean"], fx.trimmed(d) if any(d) else 0, rel_tol=1e-5, abs_tol=1e-7)


def test_sam_single_genome(spark, sample):
    alns, contigs = sample
    stats = cov.by_genome(usable(alns, Thresholds(), Flags()), cov.contigs_as_one(contigs), cov.samples_of(alns), Options(exact=True), "separator")
    d = [x for n, _ in fx.CONTIGS for x in fx.inner(n, fx.used())]
    all_ = [x for n, _ in fx.CONTIGS for x in fx.depths(n, fx.used())]
    mean, fraction, count, trimmed = _one(stats, "genome1", "mean", "covered_fraction", "count", "trimmed_mean")
    assert math.isclose(mean, sum(d) / len(d), rel_tol=1e-6) and math.isclose(fraction, sum(x > 0 for x in all_) / len(all_), rel_tol=1e-6)
    assert count == sum(not r[1] & 2048 for r in fx.used()) and math.isclose(trimmed, fx.trimmed(d), rel_tol=1e-5)


def test_a_short_contig_counts_whole_only_without_reads(spark):
    contigs = spark.createDataFrame([(0, "g~a", 100), (1, "g~b", 100), (2, "g~c", 1000)], schema.CONTIGS)
    alns = aln(spark, [("r1", 0, 0, 0, 60, "100M", 100, 0), ("r2", 0, 2, 100, 60, "100M", 100, 0)])
    samples = cov.samples_of(alns)
    by = {r["entry"]: r["windowed"] for r in cov.by_contig(alns, contigs, samples).collect()}
    assert by == {"g~a": 0, "g~b": 100, "g~c": 850}
    assert cov.by_genome(alns, cov.contigs_by_separator(contigs), samples).first()["windowed"] == 950


def test_pairs_of_a_sam(spark, sample):
    alns, _ = sample
    primary = alns.where(F.col("flag") < 2048)
    good = single_filter(primary, Thresholds(identity=0.99))
    want = [r for r in fx.used() if r[1] < 2048 and fx.identity(r) >= 0.99]
    assert sorted(r["qname"] for r in good.collect()) == sorted(r[0] for r in want)
    # p1 has 3 edits in 299 aligned bases, p2 has 1 in 280.
    assert {r["qname"] for r in pair_filter(primary, Thresholds(pair_identity=0.995)).collect()} == {"p2"}
    assert {r["qname"] for r in pair_filter(primary, Thresholds(pair_length=290)).collect()} == {"p1"}
    assert {r["qname"] for r in pair_filter(primary, Thresholds(pair_identity=0.995), inverse=True).collect()} == {"p1", "p3", "p6", "p7"}


@pytest.mark.parametrize("dense", [True, False])
def test_histogram(spark, sample, dense):
    alns, contigs = sample
    got = cov.histogram(usable(alns, Thresholds(), Flags()), contigs, cov.samples_of(alns), Options(), dense=dense).join(contigs, "tid").collect()
    want = set()
    for name in {r[2] for r in fx.used()}:
        d = fx.inner(name, fx.used())
        want |= {(name, k, d.count(k)) for k in range(max(d) + 1) if dense or d.count(k) or not k}
    assert {(r["contig"], r["depth"], r["n_bases"]) for r in got} == want and len(got) == len(want)


def test_runs_merge_over_borders(spark, sample):
    alns, contigs = sample
    whole = depth.segments(alns, contigs)
    cut = depth.merged_segments(depth.segments(alns, contigs, bin_size=16), bin_size=16)
    cols = ["tid", "start", "end", "depth"]
    assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(map(tuple, cut.select(*cols).collect()))


def test_depth_equals_per_base(spark):
    rows = [(f"q{i}", 0, 0, (i * 37) % 900, 60, f"{10 + i % 50}M{i % 3}D20M" if i % 3 else f"{10 + i % 50}M", 80, 0) for i in range(200)]
    contigs = spark.createDataFrame([(0, "c", 1000)], schema.CONTIGS)
    got = [0] * 1000
    for r in depth.segments(aln(spark, rows), contigs, bin_size=64).collect():
        for p in range(r["start"], r["end"]):
            got[p] += r["depth"]
    want = [0] * 1000
    for i in range(200):
        at, first = (i * 37) % 900, 10 + i % 50
        spans = [(at, at + first)] + ([(at + first + i % 3, at + first + i % 3 + 20)] if i % 3 else [])
        for a, b in spans:
            for p in range(a, min(b, 1000)):
                want[p] += 1
    assert got == want


def test_relative_abundance_and_unmapped(spark):
    contigs = spark.createDataFrame([(0, "a~1", 1000), (1, "b~1", 1000)], schema.CONTIGS)
    alns = aln(spark, [("r1", 0, 0, 100, 60, "100M", 100, 0), ("r2", 0, 1, 100, 60, "300M", 300, 0), ("r3", 4, None, -1, 0, "*", 50, None), ("r4", 4, None, -1, 0, "*", 50, None)])
    samples = cov.samples_of(alns)
    stats = cov.by_genome(usable(alns, Thresholds(), Flags()), cov.contigs_by_separator(contigs), samples, Options(end_exclusion=0), "separator")
    totals = cov.totals(stats, samples, ["mean"])
    final = normalise.normalised(stats, totals)
    assert {r["entry"]: r["relative_abundance"] for r in final.collect()} == {"a": 12.5, "b": 37.5}
    assert normalise.unmapped(totals).first()["relative_abundance"] == 50.0
    table = present.sparse(final, totals, ["relative_abundance"], "Genome", as_text=True).collect()
    assert [tuple(r) for r in table] == [("s", "a", "12.5"), ("s", "b", "37.5")]


def test_whole_contig_gene_is_its_contig(spark, sample):
    alns, contigs = sample
    contigs = contigs.where("length > 150")
    samples = cov.samples_of(alns)
    g = contigs.select(F.col("contig").alias("gene_id"), "contig", F.lit("CDS").alias("feature"), F.lit(0).cast("bigint").alias("start"), (F.col("length") + 5).alias("end"), F.col("tid").cast("bigint").alias("line_no"))
    used = usable(alns, Thresholds(), Flags())
    by_gene = genes.by_gene(used, genes.placed_genes(g, contigs), contigs, samples)
    by_contig = cov.by_contig(used, contigs, samples)
    cols = ["entry", "mean", "variance", "trimmed_mean", "covered_bases", "count"]
    assert sorted(map(tuple, by_gene.select(*cols).collect())) == sorted(map(tuple, by_contig.select(*cols).collect()))


def test_gff_and_definitions(spark, tmp_path):
    got = {(r["gene_id"], r["contig"], r["start"], r["end"]) for r in text.gff(spark, fx.gff(tmp_path / "a.gff")).collect()}
    assert got == {("first", "alpha~one", 100, 500), ("second", "alpha~two", 0, 700), ("beta~one_gene_1", "beta~one", 999, 5000), ("third", "elsewhere", 0, 50)}
    assert {r["gene_id"] for r in text.gff(spark, str(tmp_path / "a.gff"), "gene").collect()} == {"second"}
    (tmp_path / "d").write_text("g1\talpha~one some comment\ng2\tbeta~one\n\ng1\talpha~two\n")
    d = {(r["genome_idx"], r["genome"], r["contig"]) for r in text.definition(spark, str(tmp_path / "d")).collect()}
    assert d == {(0, "g1", "alpha~one"), (0, "g1", "alpha~two"), (1, "g2", "beta~one")}
    for bad in ("g1\tc\tx\n", "g1\tc\ng2\tc\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception, match="not two columns|named twice"):
            text.definition(spark, str(tmp_path / "bad")).collect()
    sequences = [("c1", "ACGT" * 40), ("c2", "GGCC" * 11)]
    f = {r["contig"]: r["seq"] for r in text.fasta(spark, fx.fasta(tmp_path / "x.fna", sequences)).collect()}
    assert f == dict(sequences)
    (tmp_path / "q.tsv").write_text("Bin Id\tMarker lineage\tCompleteness\tContamination\na\tx\t99.5\t0.5\nb\tx\t40\t12\n")
    q = text.quality(spark, str(tmp_path / "q.tsv"))
    assert {r["genome"]: r["completeness"] for r in q.collect()} == {"a": 99.5, "b": 40.0}
    both = spark.createDataFrame([("a",), ("b",)], "genome string")
    assert [r["genome"] for r in text.good_genomes(both, q, 50, 10).collect()] == ["a"]


def _bam(path, contigs, records):
    """Write a small BAM file, in two blocks."""
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    body = b""
    for name, flag, tid, pos, mapq, ops, l_seq, nm in records:
        data = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, l_seq, tid, 0, 0) + name.encode() + b"\0"
        data += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in ops) + b"\0" * ((l_seq + 1) // 2) + b"\xff" * l_seq + b"XSZhello\0" + b"NMC" + struct.pack("<B", nm)
        body += struct.pack("<i", len(data)) + data
    raw, out = head + body, b""
    for part in (raw[:70], raw[70:], b""):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    path.write_bytes(out)


def test_bam_round_trip(spark, tmp_path):
    _bam(tmp_path / "one.bam", [("c1", 500), ("c2", 700)], [("r1", 99, 0, 10, 60, [(20, "M"), (1, "D"), (30, "M")], 50, 2), ("r2", 4, -1, -1, 0, [], 25, 0)])
    binary.register(spark)
    rows = spark.read.format("bam").load(str(tmp_path / "one.bam")).orderBy("qname").collect()
    assert [(r["sample"], r["qname"], r["flag"], r["tid"], r["pos"], r["cigar"], r["seq_len"], r["nm"]) for r in rows] == [("one", "r1", 99, 0, 10, "20M1D30M", 50, 2), ("one", "r2", 4, None, -1, "*", 25, 0)]
    assert [tuple(r) for r in binary.bam_contigs(spark, str(tmp_path / "one.bam")).collect()] == [(0, "c1", 500), (1, "c2", 700)]


def test_reads(spark, tmp_path):
    binary.register(spark)
    one, two = (fx.fastq(tmp_path / f"r.{k}.fq", [(f"x{i}/{k}", "ACGT" * 5) for i in range(20)]) for k in (1, 2))
    df = spark.read.format("fastq").load(f"{one},{two}")
    assert df.groupBy("mate").count().orderBy("mate").collect() == [(1, 20), (2, 20)]
    assert {r["seq"] for r in spark.read.format("fastq").load(fx.fasta(tmp_path / "y.fq", [("a", "AC" * 60)])).collect()} == {"AC" * 60}


def test_text_of_numbers(spark):
    df = spark.createDataFrame([(1.0,), (0.25,), (2.4e7,), (1e-5,), (float("nan"),), (0.0,)], "x float")
    assert [r[0] for r in df.select(plain_text(F.col("x"))).collect()] == ["1", "0.25", "24000000", "0.00001", "NaN", "0"]
    assert percentage(95) == 0.95 and percentage(0.3) == 0.3
    with pytest.raises(ValueError):
        percentage(101)


def test_method_rules():
    with pytest.raises(ValueError):
        cov.check_methods(["metabat", "mean"], Options())
    with pytest.raises(ValueError):
        cov.check_methods(["count"], Options(min_covered_fraction=0.1))
    cov.check_methods(["mean", "rpkm"], Options(min_covered_fraction=0.1))


def test_added_methods(spark, sample):
    alns, contigs = sample
    cov.add_method("median_depth", "Median", cov.share_of_depths(0.5))
    try:
        stats = cov.by_contig(usable(alns, Thresholds(), Flags()), contigs, cov.samples_of(alns), Options())
        assert stats._jdf.queryExecution().executedPlan().toString().count("FileScan text") == cov.by_contig(alns, contigs, cov.samples_of(alns))._jdf.queryExecution().executedPlan().toString().count("FileScan text")
        for r in stats.collect():
            d = sorted(fx.inner(r["entry"], fx.used()))
            assert r["median_depth"] == (d[(len(d) + 1) // 2 - 1] if d else 0)
        with pytest.raises(ValueError):
            cov.add_method("mean", "x", lambda o: F.lit(1))
    finally:
        cov.remove_method("median_depth")
    with pytest.raises(ValueError):
        cov.check_methods(["median_depth"], Options())


def test_bam_in_splits(spark, tmp_path):
    """Records lie across blocks; some are longer than many blocks, and one has more operations than its field holds."""
    contigs = spark.createDataFrame([(0, "c1", 5_000_000), (1, "c2", 700)], schema.CONTIGS)
    rows = []
    for i in range(600):
        cigar, bases = ("40M2D60M", 100) if i % 97 else ("1M1I" * 4_000, 8_000)
        rows.append(("reads", 0, f"read{i}", 99 if i % 3 else 4, i % 2 if i % 3 else None, i * 7 if i % 3 else -1, i % 60, cigar if i % 3 else "*", i % 2 if i % 5 else None, i if i % 5 else -1, i - 300, bases, i % 9 if i % 4 else None, 100 - i % 9 if i % 4 else None, 0))
    rows.append(("reads", 0, "long", 0, 0, 10, 60, "1M1D" * 40_000, None, -1, 0, 40_000, 3, 7, 0))
    alns = spark.createDataFrame(rows, schema.ALIGNMENTS).repartition(2)
    path = str(tmp_path / "reads.bam")
    binary.write_bam(alns, contigs, path, block_bytes=700)
    for split in (1_500, 10_000, 1 << 26):
        got = spark.read.format("bam").option("split_bytes", split).load(path)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(rows, key=lambda r: r[2])
        assert (got.rdd.getNumPartitions() > 10) == (split == 1_500)
    assert [tuple(r) for r in binary.bam_contigs(spark, path).collect()] == [(0, "c1", 5_000_000), (1, "c2", 700)]
    binary.write_bam(alns.where("false"), contigs, str(tmp_path / "none.bam"))
    assert spark.read.format("bam").load(str(tmp_path / "none.bam")).count() == 0


@pytest.fixture
def table(spark):
    """Alignments and contigs without the steps that read files."""
    return aln(spark, [("q1", 0, 0, 5, 60, "10M", 10, 0), ("q2", 0, 0, 9, 60, "10M2D10M", 20, 2)]), spark.createDataFrame([(0, "c", 1000)], schema.CONTIGS)


def test_runs_are_made_by_one_shuffle(spark, table):
    """Blocks are dealt out by bin once, and nothing is added up before that: a task's memory does not grow with the different ends that it meets."""
    alns, contigs = table
    plan = depth.segments(alns, contigs)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("hashpartitioning(sample_idx") == 1


def test_changes_at_one_place(spark):
    """Blocks that end where others begin leave depth as it is; several changes at one place are one."""
    blocks = [(0, 10), (10, 20), (10, 16), (16, 20), (20, 30), (20, 30), (40, 45)]
    alns = aln(spark, [(f"q{s}-{e}", 0, 0, s, 60, f"{e - s}M", e - s, 0) for s, e in blocks])
    contigs = spark.createDataFrame([(0, "c", 1000)], schema.CONTIGS)
    for size in (depth.BIN, 8):
        got = depth.merged_segments(depth.segments(alns, contigs, size), size).orderBy("start").collect()
        assert [(r["start"], r["end"], r["depth"]) for r in got] == [(0, 10, 1), (10, 30, 2), (40, 45, 1)]


def test_runs_are_made_once_to_be_merged(spark, table):
    """Runs that touch a border and the others are told apart after they have been made, not by making them twice."""
    alns, contigs = table
    plan = depth.merged_segments(depth.segments(alns, contigs, 16), 16).select("tid", "start", "end", "depth")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_genes_meet_runs_where_they_lie(spark, table):
    """Runs are dealt out by sample, contig and bin; they are not moved again to meet genes."""
    alns, contigs = table
    rows = contigs.select(F.col("contig").alias("gene_id"), "contig", F.lit("CDS").alias("feature"), F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), F.col("tid").cast("bigint").alias("line_no"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = genes.by_gene(alns, genes.placed_genes(rows, contigs), contigs, cov.samples_of(alns), trimmed=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(tid#\d+, bin", plan)
