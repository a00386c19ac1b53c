import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import fixtures as fx
from strandlake import cli, schema, sql
from strandlake.mapping import commands
from strandlake.operators import cluster, depth, shard
from strandlake.streaming.incremental import CoverageState


def _genomes():
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(20_000))
    other = "".join(rng.choice("ACGT") for _ in range(20_000))
    near = "".join(rng.choice("ACGT") if rng.random() < 0.005 else c for c in base)
    return {"a": base, "b": near, "c": other}


def test_cluster(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    seqs = spark.createDataFrame(list(_genomes().items()), "genome string, seq string")
    genomes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "genome string, genome_idx int")
    edges = cluster.similar(cluster.sketches(seqs), 0.95)
    assert [(r["a"], r["b"]) for r in edges.collect()] == [("a", "b")] and edges.first()["ani"] > 0.98
    got = cluster.representatives(cluster.ranked(genomes), edges)
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("a", "b"), ("c", "c")}
    quality = spark.createDataFrame([("a", 50.0, 0.0), ("b", 100.0, 0.0)], schema.QUALITY)  # c has none and stays
    got = cluster.representatives(cluster.ranked(genomes, quality), edges)
    assert {tuple(r) for r in got.collect()} == {("b", "a"), ("b", "b"), ("c", "c")}


def test_representatives_are_greedy(spark):
    """Rounds of joins give what a pass over the genomes in order gives."""
    rng = random.Random(9)
    names = [f"g{i:02}" for i in range(40)]
    links = {(a, b): round(rng.uniform(0.95, 1), 3) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.12}
    scores = {n: float(rng.randrange(10)) for n in names}
    want, chosen = set(), []
    for g in sorted(names, key=lambda n: (-scores[n], n)):
        close = [(-links.get((min(r, g), max(r, g)), 0), k, r) for k, r in enumerate(chosen) if (min(r, g), max(r, g)) in links]
        if not close:
            chosen.append(g)
        want.add((min(close)[2] if close else g, g))
    genomes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "genome string, genome_idx int")
    quality = spark.createDataFrame([(n, x, 0.0) for n, x in scores.items()], schema.QUALITY)
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in links.items()], "a string, b string, ani double")
    assert {tuple(r) for r in cluster.representatives(cluster.ranked(genomes, quality), edges).collect()} == want


def test_genome_stats(spark):
    seqs = spark.createDataFrame([("a", "ACGTN" * 20), ("a", "A" * 50), ("a", "C" * 50), ("b", "ACGT")], "genome string, seq string")
    got = {r["genome"]: r for r in cluster.genome_stats(seqs).collect()}
    assert (got["a"]["n_contigs"], got["a"]["n_ambiguous"], got["a"]["n50"], got["b"]["n50"]) == (3, 20, 100, 4)
    quality = spark.createDataFrame([("a", 90.0, 2.0, 50.0), ("b", 90.0, 2.0, 50.0)], "genome string, completeness double, contamination double, strain_heterogeneity double")
    genomes = spark.createDataFrame([("a", 0), ("b", 1)], "genome string, genome_idx int")
    for formula, a in (("Parks2020_reduced", 90 - 10 - 0.15 - 0.001), ("dRep", 90 - 10 + 1 + 1)):
        order = {r["genome"]: r["order"]["worse"] for r in cluster.ranked(genomes, quality.join(cluster.genome_stats(seqs), "genome"), formula).collect()}
        assert abs(order["a"] + a) < 1e-9


def test_shards(spark):
    rows = [("s", 0, "p", 99, 0, 5, 60, "50M", 0, 0, 0, 50, 0, 50, 0), ("s", 0, "p", 147, 0, 9, 60, "50M", 0, 0, 0, 50, 0, 40, 0), ("s", 0, "p", 99, 1, 5, 60, "50M", 1, 0, 0, 50, 0, 60, 1), ("s", 0, "p", 133, None, -1, 0, "*", None, 0, 0, 50, None, None, 1)]
    alns = spark.createDataFrame(rows, schema.ALIGNMENTS)
    contigs = spark.createDataFrame([(0, 0, "g1~a", 100), (0, 1, "g1~b", 100), (1, 0, "g2~a", 100), (1, 1, "g3~a", 100)], "shard int, tid int, contig string, length bigint")
    best = shard.best_shard(alns, contigs).collect()
    assert {(r["shard"], r["tid"]) for r in best} == {(0, 0)} and len(best) == 2
    names = spark.createDataFrame([("g1",)], "genome string")
    best = shard.best_shard(alns, contigs, shard.excluded_contigs(contigs, names)).collect()
    assert {(r["shard"], r["tid"]) for r in best} == {(1, 3), (1, None)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", 0, f"q{i}", 0, i % 2, (i * 31) % 700, 60, "100M", i % 2, 0, 0, 100, 0, 0, 0) for i in range(60)]
    contigs = spark.createDataFrame([(0, "a", 1000), (1, "b", 1000)], schema.CONTIGS)
    alns = spark.createDataFrame(rows, schema.ALIGNMENTS)
    for k in range(3):
        alns.where(F.col("pos") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    state = CoverageState(str(tmp_path / "state"), contigs)
    stream = spark.readStream.schema(schema.ALIGNMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = state.start(stream, str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["tid", "start", "end", "depth"]
    assert sorted(map(tuple, state.segments().select(*cols).collect())) == sorted(map(tuple, depth.segments(alns, contigs).select(*cols).collect()))
    assert state.counts().agg(F.sum("n_all")).first()[0] == 60


def test_commands():
    pair, both, one = commands.read_sets(read1=["a1.fq"], read2=["a2.fq"], interleaved=["b.fq"], single=["c.fq"])
    assert commands.mapping_command("minimap2-sr", "ref.fa", pair, 4)[-3:] == ["ref.fa", "a1.fq", "a2.fq"]
    assert "-p" in commands.mapping_command("bwa-mem", "ref.fa", both) and "--interleaved" in commands.mapping_command("strobealign", "ref.fa", both)
    assert "--frag" in commands.mapping_command("minimap2-sr", "ref.fa", one) and commands.sample_name("x/ref.fa", pair) == "ref.fa/a1.fq"
    assert commands.mapping_command("rammap-lr-hq", "ref.fa", one)[:4] == ["rammap", "-a", "-x", "lr:hq"] and commands.mapping_command("minibwa", "ref.fa", pair)[:2] == ["minibwa", "map"]
    for mapper, reads in (("minimap2-ont", pair), ("rammap-hifi", both), ("minibwa", both), ("none", one)):
        with pytest.raises(ValueError):
            commands.mapping_command(mapper, "ref.fa", reads)
    with pytest.raises(ValueError):
        commands.read_sets(read1=["a"], read2=[])
    with pytest.raises(ValueError):
        commands.read_sets(coupled=["a"])


def test_command_line(spark, tmp_path):
    path, out = fx.sam(tmp_path / "one.sam"), tmp_path / "out.tsv"
    used, lengths = fx.used(), dict(fx.CONTIGS)
    cli.main(["contig", "-b", path, "-m", "mean", "covered_fraction", "--output-format", "sparse", "--no-zeros", "-o", str(out)], spark)
    lines = [x.split("\t") for x in out.read_text().splitlines()]
    assert lines[0] == ["Sample", "Contig", "Mean", "Covered Fraction"] and [x[:2] for x in lines[1:]] == [["one", n] for n in ("alpha~one", "alpha~two", "beta~one")]
    for _, name, mean, fraction in lines[1:]:
        d = fx.inner(name, used)
        assert abs(float(mean) - sum(d) / len(d)) < 1e-6 and abs(float(fraction) - sum(x > 0 for x in fx.depths(name, used)) / lengths[name]) < 1e-6
    cli.main(["genome", "--single-genome", "-b", path, "-m", "mean", "covered_fraction", "--min-covered-fraction", "0", "-o", str(out)], spark)
    head, line = (x.split("\t") for x in out.read_text().splitlines())
    d = [x for n in lengths for x in fx.inner(n, used)]
    assert head == ["Genome", "one Mean", "one Covered Fraction"] and line[0] == "genome1" and abs(float(line[1]) - sum(d) / len(d)) < 1e-6
    cli.main(["contig", "-b", path, "-m", "mean", "mean", "-o", str(out)], spark)  # equal methods
    assert out.read_text().splitlines()[0] == "Contig\tone Mean\tone Mean" and all(x.split("\t")[1] == x.split("\t")[2] for x in out.read_text().splitlines())
    with pytest.raises(ValueError):
        cli.main(["contig", "-b", path, "-m", "strobealign-aemb"], spark)
    cli.main(["genome", "-s", "~", "-b", path, "--min-covered-fraction", "0", "-o", str(out)], spark)
    lines = dict(x.split("\t") for x in out.read_text().splitlines())
    # Nine primary records, of which two are unmapped; a record of a supplementary kind is not among them.
    assert set(lines) == {"Genome", "unmapped", "alpha", "beta", "gamma"} and abs(sum(float(lines[k]) for k in ("unmapped", "alpha", "beta", "gamma")) - 100) < 1e-3
    assert abs(float(lines["unmapped"]) - 100 * 2 / 9) < 1e-4 and float(lines["alpha"]) > float(lines["beta"]) > float(lines["gamma"]) == 0


@pytest.fixture
def fake_mapper(spark, tmp_path):
    """A program by the name of a mapper: it writes the SAM file beside the reference, or as many reads as there are arguments."""
    folder = tmp_path / "bin"
    folder.mkdir()
    tool = folder / "strobealign"
    tool.write_text('#!/bin/sh\nfor x; do case "$x" in --version) echo 0.14.0; exit;; --aemb) aemb=1;; *.fa) ref="$x";; esac; done\n'
                    'if [ "$aemb" ]; then printf "alpha~one\\t1.5\\nbeta~one\\t0\\n"; else cat "${ref%.fa}.sam"; fi\n')
    tool.chmod(0o755)
    shared = spark.sparkContext.environment
    before = shared.get("PATH")
    shared["PATH"] = f"{folder}{os.pathsep}{os.environ['PATH']}"
    yield tool
    shared.pop("PATH") if before is None else shared.update(PATH=before)


def _lines(path):
    return [x.split("\t") for x in path.read_text().splitlines()]


def test_mapping(spark, tmp_path, fake_mapper):
    rng, out = random.Random(3), tmp_path / "out.tsv"
    sequences = [(n, "".join(rng.choice("ACGT") for _ in range(x))) for n, x in fx.CONTIGS]
    ref, sam = fx.fasta(tmp_path / "ref.fa", sequences), fx.sam(tmp_path / "ref.sam")
    reads = ["-r", ref, "-1", "a_1.fq", "-2", "a_2.fq", "--single", "b.fq"]
    cli.main(["contig", "-b", sam, "-m", "mean", "-o", str(out)], spark)
    want = {x[0]: x[1] for x in _lines(out)[1:]}
    cache = tmp_path / "cache"
    cli.main(["contig", *reads, "-m", "mean", "-o", str(out), "--bam-file-cache-directory", str(cache), "--discard-unmapped"], spark)
    head, *lines = _lines(out)
    assert head == ["Contig", "ref.fa/a_1.fq Mean", "ref.fa/b.fq Mean"] and {x[0]: x[1] for x in lines} == want == {x[0]: x[2] for x in lines}
    kept = sorted(str(p) for p in cache.iterdir())
    assert [os.path.basename(p) for p in kept] == ["ref.fa.a_1.fq.bam", "ref.fa.b.fq.bam"]
    cli.main(["contig", "-b", kept[0], "-m", "mean", "-o", str(out)], spark)  # by way of BAM files
    assert {x[0]: x[1] for x in _lines(out)[1:]} == want
    cli.main(["contig", *reads, "-m", "strobealign-aemb", "-o", str(out)], spark)
    assert _lines(out) == [["Contig", "ref.fa/a_1.fq Strobealign aemb", "ref.fa/b.fq Strobealign aemb"], ["alpha~one", "1.5", "1.5"], ["beta~one", "0", "0"]]
    fake_mapper.write_text("#!/bin/sh\necho 0.10.0\n")
    with pytest.raises(Exception, match="older than"):
        cli.main(["make", *reads, "-o", str(tmp_path / "made")], spark)


def test_sharded_command(spark, tmp_path):
    out, names = tmp_path / "out.tsv", tmp_path / "names"
    for name, score in (("one", 90), ("two", 80)):
        rows = ["@SQ\tSN:%s~c\tLN:500" % name, *("\t".join(["p", str(f), f"{name}~c", str(pos), "60", "100M", "=", "1", "0", "A" * 100, "*", "NM:i:0", f"AS:i:{score}"]) for f, pos in ((99, 101), (147, 201)))]
        (tmp_path / f"{name}.sam").write_text("\n".join(rows) + "\n")
    call = ["genome", "-s", "~", "-b", str(tmp_path / "one.sam"), str(tmp_path / "two.sam"), "--sharded", "-m", "covered_bases", "--min-covered-fraction", "0", "-o", str(out)]
    cli.main(call, spark)
    assert _lines(out) == [["Genome", "one|two Covered Bases"], ["one", "200"], ["two", "0"]]
    names.write_text("one\n")
    cli.main([*call, "--exclude-genomes-from-deshard", str(names)], spark)
    assert _lines(out)[1:] == [["one", "0"], ["two", "200"]]


def test_dereplicate_command(spark, tmp_path):
    out, table = tmp_path / "out.tsv", tmp_path / "quality.tsv"
    files = [fx.fasta(tmp_path / f"{n}.fna", [(f"{n}_c", s)]) for n, s in _genomes().items()]
    table.write_text("Bin Id\tCompleteness\tContamination\tStrain heterogeneity\na\t80\t1\t0\nb\t95\t1\t0\nc\t60\t1\t0\n")
    cli.main(["cluster", "-f", *files, "--checkm-tab-table", str(table), "--quality-formula", "dRep", "-o", str(out)], spark)
    assert _lines(out)[1:] == [["b", "a"], ["b", "b"], ["c", "c"]]
    cli.main(["cluster", "-f", files[1], files[2], "--reference-genomes", files[0], "-o", str(out)], spark)
    assert _lines(out)[1:] == [["a", "a"], ["a", "b"], ["c", "c"]]
    (tmp_path / "x.sam").write_text("".join(f"@SQ\tSN:{n}_c\tLN:20000\n" for n in "abc") + "\t".join(["r", "0", "b_c", "101", "60", "100M", "*", "0", "0", "A" * 100, "*", "NM:i:0"]) + "\n")
    call = ["genome", "-f", *files, "-b", str(tmp_path / "x.sam"), "-m", "covered_bases", "--min-covered-fraction", "0", "-o", str(out), "--checkm-tab-table", str(table)]
    cli.main([*call, "--dereplicate"], spark)
    assert [x[0] for x in _lines(out)[1:]] == ["b", "c"] and _lines(out)[1][1] == "100"
    cli.main([*call, "--min-completeness", "70"], spark)
    assert [x[0] for x in _lines(out)[1:]] == ["a", "b"]


def test_sql(spark):
    sql.register(spark, numbers=spark.range(3))
    assert [tuple(r) for r in spark.sql("SELECT * FROM cigar_blocks('4M1D145M', 10)").collect()] == [(10, 14), (15, 160)]
    assert spark.sql("SELECT count(*) FROM numbers").first()[0] == 3


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
