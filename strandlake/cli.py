"""Command line: coverage of contigs and genomes, filters, mapping, and groups of genomes, over SAM and BAM files or reads."""

from __future__ import annotations

import argparse
import functools
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import percentage
from .mapping import run
from .mapping.commands import MAPPERS, ReadSet, read_sets, sample_name
from .operators import cluster, coverage, fragments, genes, normalise, order, present, shard
from .operators.coverage import Options
from .operators.filters import METABAT, Flags, Thresholds, has, threshold_filter, usable
from .schema import UNMAPPED
from .scratch import written
from .sources import binary, text
from .sources.headers import Headers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def reads(c: argparse.ArgumentParser) -> None:
        c.add_argument("-r", "--reference", nargs="+", default=[], help="FASTA files that reads are mapped to")
        c.add_argument("-p", "--mapper", choices=MAPPERS, default="strobealign")
        c.add_argument("-t", "--threads", type=int, default=1)
        c.add_argument("--mapper-params", default="")
        for short, name in (("-1", "read1"), ("-2", "read2"), ("-c", "coupled"), (None, "interleaved"), (None, "single")):
            c.add_argument(*([short] if short else []), f"--{name}", nargs="+", default=[])
        c.add_argument("--discard-unmapped", action="store_true", help="leave reads that are not mapped out of the files that are written")

    def qualities(c: argparse.ArgumentParser, prefix: str) -> None:
        for name in ("checkm-tab-table", "checkm2-quality-report", "genome-info"):
            c.add_argument(f"--{name}", dest="quality_table")
        c.add_argument("--min-completeness", type=float, default=0.0)
        c.add_argument("--max-contamination", type=float, default=100.0)
        c.add_argument(f"--{prefix}ani", dest="ani", type=float, default=95.0)
        c.add_argument(f"--{prefix}prethreshold-ani", dest="prethreshold_ani", type=float, default=90.0, help="sketches at least so alike are compared fragment by fragment")
        c.add_argument(f"--{prefix}aligned-fraction", f"--{prefix}min-aligned-fraction", dest="aligned_fraction", type=float, default=15.0)
        c.add_argument(f"--{prefix}fragment-length", dest="fragment_length", type=int, default=fragments.FRAGMENT)
        c.add_argument(f"--{prefix}quality-formula", dest="quality_formula", choices=list(cluster.FORMULAS), default="completeness-4contamination")
        c.add_argument("--reference-genomes", nargs="+", default=[], help="FASTA files of genomes that are representatives beforehand")

    def common(name: str, help_: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        c.add_argument("-b", "--bam-files", nargs="+", default=[], required=name == "filter", help="SAM or BAM files, a sample each")
        c.add_argument("-o", "--output-file", **({"nargs": "+", "required": True} if name == "filter" else {"default": "-"}))
        for kind in ("", "-pair"):
            c.add_argument(f"--min-read-aligned-length{kind}", type=int, default=0)
            c.add_argument(f"--min-read-percent-identity{kind}", type=percentage_option, default=0.0)
            c.add_argument(f"--min-read-aligned-percent{kind}", type=percentage_option, default=0.0)
        c.add_argument("--min-mapq", type=int, default=255)
        c.add_argument("--proper-pairs-only", action="store_true")
        c.add_argument("--exclude-supplementary", action="store_true")
        c.add_argument("--include-secondary", action="store_true")
        return c

    for name, method, fraction in (("contig", "mean", 0.0), ("genome", "relative_abundance", 10.0)):
        c = common(name, f"coverage of each {name}")
        c.add_argument("-m", "--methods", nargs="+", default=[method])
        c.add_argument("--trim-min", type=float, default=5.0)
        c.add_argument("--trim-max", type=float, default=95.0)
        c.add_argument("--min-covered-fraction", type=float, default=fraction)
        c.add_argument("--contig-end-exclusion", type=int, default=75)
        c.add_argument("--output-format", choices=["dense", "sparse"], default="dense")
        c.add_argument("--no-zeros", action="store_true")
        c.add_argument("--check-sorted", action="store_true", help="fail if a file is not sorted by reference; no operator needs it to be")
        c.add_argument("--gff")
        c.add_argument("--gff-feature-type")
        reads(c)
        c.add_argument("--sharded", action="store_true", help="files or references are parts of one reference; each pair counts where it aligns best")
        c.add_argument("--exclude-genomes-from-deshard", help="a list of genomes that take no part in that")
        c.add_argument("--bam-file-cache-directory", help="alignments of mapped reads are kept there, a folder of BAM files a sample")
        if name == "genome":
            c.add_argument("-s", "--separator")
            c.add_argument("--single-genome", action="store_true")
            c.add_argument("--genome-definition")
            c.add_argument("-f", "--genome-fasta-files", nargs="+")
            c.add_argument("-d", "--genome-fasta-directory")
            c.add_argument("-x", "--genome-fasta-extension", default="fna")
            c.add_argument("--genome-fasta-list")
            c.add_argument("--use-full-contig-names", action="store_true")
            c.add_argument("--dereplicate", action="store_true", help="only representatives of similar genomes are reported")
            qualities(c, "dereplication-")
    f = common("filter", "write the alignments that pass, as a folder of BAM files if its name ends so, else as Parquet")
    f.add_argument("--inverse", action="store_true")
    c = sub.add_parser("cluster", help="representatives of similar genomes")
    c.add_argument("-f", "--genome-fasta-files", nargs="+", required=True)
    qualities(c, "")
    c.add_argument("-o", "--output-cluster-definition", default="-")
    c = sub.add_parser("make", help="map reads and keep the alignments, a folder of BAM files a sample")
    reads(c)
    c.add_argument("-o", "--output-directory", required=True)
    return p


def percentage_option(value: str) -> float:
    return percentage(float(value))


def thresholds(a: argparse.Namespace) -> tuple[Thresholds, Flags]:
    t = Thresholds(
        a.min_read_aligned_length, a.min_read_percent_identity, a.min_read_aligned_percent, a.min_read_aligned_length_pair, a.min_read_percent_identity_pair, a.min_read_aligned_percent_pair, a.min_mapq
    )
    return t, Flags(improper=not (a.proper_pairs_only or t.any_pair), secondary=a.include_secondary, supplementary=not a.exclude_supplementary)


def alignments(spark: SparkSession, paths: Sequence[str], whole: bool = False) -> tuple[DataFrame, Headers]:
    """Alignments of SAM or BAM files and the headers of these; ``whole``: with the records themselves, to be written."""
    if all(p.endswith(".bam") for p in paths):
        return binary.bam_and_headers(spark, list(paths), more="raw" if whole else "")
    return text.sam_and_headers(spark, list(paths), ["line"] if whole else [])


def check_sorted(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise ValueError if a file is not sorted by its own header."""
    if all(p.endswith(".bam") for p in paths):
        binary.register(spark)
        order.check_sorted(spark.read.format("bam").option("more", "place").load(",".join(paths)))
    else:
        for p in paths:
            order.check_sorted(text.sam(spark, [p], more=["place"]))


def filtered(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write what passes, whole: a sorted folder of BAM files for each input, or all of it as Parquet."""
    t, flags = thresholds(a)
    if not all(o.endswith(".bam") for o in a.output_file):
        rows, _ = alignments(spark, a.bam_files)
        threshold_filter(rows, t, flags, a.inverse, exact=True).write.mode("overwrite").parquet(a.output_file[0])
        return
    if len(a.output_file) != len(a.bam_files):
        raise ValueError("give an output for each input, or one that is Parquet")
    for path, out in zip(a.bam_files, a.output_file):
        rows, headers = alignments(spark, [path], whole=True)
        binary.write_bam(threshold_filter(rows, t, flags, a.inverse, exact=True), path if path.endswith(".bam") else headers.contigs, out)


def _sets(a: argparse.Namespace) -> list[ReadSet]:
    return read_sets(a.coupled, a.read1, a.read2, a.interleaved, a.single)


def mapped(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(alignments, contigs by shard) of reads."""
    if not a.reference:
        raise ValueError("give alignments, or reads and a reference")
    contigs = written(run.reference_contigs(spark, a.reference), "contigs")
    whole = a.command == "make" or bool(a.bam_file_cache_directory)
    return run.mapped(spark, a.mapper, a.reference, _sets(a), a.threads, a.mapper_params, contigs, whole), contigs


def keep(rows: DataFrame, contigs: DataFrame, a: argparse.Namespace, folder: str) -> None:
    """Write a folder of BAM files for each sample and reference."""
    parts = rows.select("sample", "sample_idx", "shard").distinct().orderBy("shard", "sample_idx").collect()  # a row per run of the mapper
    names = [r["sample"].replace("/", ".") if len(a.reference) == 1 else sample_name(a.reference[r["shard"]], ReadSet((r["sample"],))).replace("/", ".") for r in parts]
    if len({*names}) < len(names):
        raise ValueError(f"two outputs have one name: {sorted(n for n in {*names} if names.count(n) > 1)}")
    for name, r in zip(names, parts):
        own = rows.where((F.col("sample_idx") == r["sample_idx"]) & (F.col("shard") == r["shard"]))
        binary.write_bam(own.where(~has(UNMAPPED)) if a.discard_unmapped else own, contigs.where(F.col("shard") == r["shard"]), f"{folder.rstrip('/')}/{name}.bam")


def inputs(spark: SparkSession, a: argparse.Namespace, genomes: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alignments, contigs, samples) of ``contig`` and ``genome``: of files or of reads, in one part or in shards."""
    if a.bam_files and a.check_sorted:
        check_sorted(spark, a.bam_files)
    if a.bam_files and not a.sharded:
        rows, headers = alignments(spark, a.bam_files)
        return rows, headers.contigs, headers.samples(coverage.samples_of(rows))
    rows, contigs = parts_of(spark, a, genomes)
    return rows, contigs, coverage.samples_of(rows)


def parts_of(spark: SparkSession, a: argparse.Namespace, genomes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(alignments, contigs) of reads that are mapped here, or of files that are shards."""
    if a.bam_files:
        name, parts = "|".join(map(text.stem, a.bam_files)), [(r, h.contigs) for r, h in (alignments(spark, [p]) for p in a.bam_files)]
        rows = functools.reduce(DataFrame.unionByName, (r.withColumns({"shard": F.lit(i), "sample": F.lit(name)}) for i, (r, _) in enumerate(parts)))
        contigs = functools.reduce(DataFrame.unionByName, (c.withColumn("shard", F.lit(i)) for i, (_, c) in enumerate(parts)))
    else:
        if len(a.reference) > 1 and not a.sharded:
            raise ValueError("several references are the parts of one with --sharded; otherwise make a call for each")
        rows, contigs = mapped(spark, a)
        if a.bam_file_cache_directory:
            keep(rows, contigs, a, a.bam_file_cache_directory)
    if not a.sharded:
        return rows, contigs.drop("shard")
    excluded = None
    if a.exclude_genomes_from_deshard:
        separator = None if genomes is not None else getattr(a, "separator", None)
        if genomes is None and not separator:
            raise ValueError("genomes can be excluded where genomes are told by a separator, a definition or files")
        named = contigs if genomes is None else contigs.join(genomes.select("contig", "genome"), "contig")
        excluded = shard.excluded_contigs(named, text.names(spark, a.exclude_genomes_from_deshard), separator)
    return shard.best_shard(rows, contigs, excluded), shard.merged_contigs(contigs).select("tid", "contig", "length")


def similar_genomes(sequences: DataFrame, ani: float, first_ani: float, share: float, fragment_length: int) -> DataFrame:
    """(a, b, ani): pairs whose sketches are ``first_ani`` alike, and which fragment by fragment are ``ani`` alike over a ``share`` of their fragments. Pairs of
    genomes too small for a fragment are judged by their sketches."""
    pairs = written(cluster.similar(written(cluster.sketches(sequences), "sketches"), min(ani, first_ani)), "pairs")
    wanted = pairs.select(F.col("a").alias("genome")).union(pairs.select("b")).distinct()
    hashes = written(fragments.fragment_hashes(sequences.join(wanted, "genome", "left_semi"), fragment_length), "fragments")
    known = fragments.identities(pairs, hashes).withColumnsRenamed({"ani": "_ani", "share": "_share"})
    judged = pairs.join(known, ["a", "b"], "left").select("a", "b", F.when(F.col("_share").isNull(), F.col("ani")).otherwise(F.col("_ani")).alias("ani"), F.coalesce("_share", F.lit(1.0)).alias("share"))
    return judged.where((F.col("ani") >= ani) & (F.col("share") >= share)).select("a", "b", "ani")


def clusters(spark: SparkSession, a: argparse.Namespace, paths: Sequence[str]) -> DataFrame:
    """(representative, member) of genome files, by the options of quality and identity."""
    every = [*a.reference_genomes, *(p for p in paths if p not in a.reference_genomes)]
    genomes = spark.createDataFrame([(text.genome_stem(p), i, i < len(a.reference_genomes)) for i, p in enumerate(every)], "genome string, genome_idx int, given boolean")
    sequences = text.genome_sequences(spark, every).select("genome", "contig", "seq")
    quality = text.quality(spark, a.quality_table) if a.quality_table else None
    if quality is not None:
        genomes = genomes.where("given").unionByName(text.good_genomes(genomes.where("not given"), quality, a.min_completeness, a.max_contamination))
        sequences = sequences.join(genomes.select("genome"), "genome", "left_semi")
        if a.quality_formula in cluster.OF_SEQUENCES:
            quality = quality.join(cluster.genome_stats(sequences), "genome")
    edges = similar_genomes(sequences, percentage(a.ani), percentage(a.prethreshold_ani), percentage(a.aligned_fraction), a.fragment_length)
    return cluster.representatives(cluster.ranked(genomes, quality, a.quality_formula), edges)


def genome_map(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """(genome_idx, genome, contig) where genomes are told by a definition or by files, less those that the options leave out."""
    if a.command != "genome" or a.single_genome or a.separator:
        return None
    if a.genome_definition:
        return text.definition(spark, a.genome_definition)
    paths = text.fasta_paths(a.genome_fasta_files or (), a.genome_fasta_directory, a.genome_fasta_extension, a.genome_fasta_list)
    genomes = text.genomes_from_fasta(spark, paths, a.use_full_contig_names)
    if a.dereplicate:
        return genomes.join(clusters(spark, a, paths).select(F.col("representative").alias("genome")).distinct(), "genome", "left_semi")
    if a.quality_table:
        return text.good_genomes(genomes, text.quality(spark, a.quality_table), a.min_completeness, a.max_contamination)
    return genomes


def abundance_table(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What the mapper's abundance mode says of each contig."""
    if a.bam_files or len(a.reference) != 1 or a.mapper != "strobealign":
        raise ValueError("strobealign-aemb needs reads and one reference, and is done by strobealign")
    names = [(k, sample_name(a.reference[0], s)) for k, s in enumerate(_sets(a))]
    stats = run.abundances(spark, a.reference[0], _sets(a), a.threads, a.mapper_params)
    if a.output_format == "dense":
        return present.dense(stats, names, a.methods, as_text=True)
    return present.sparse(stats.drop("sample"), spark.createDataFrame(names, "sample_idx int, sample string"), a.methods, as_text=True)


def table_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result table of ``contig`` and ``genome``."""
    o = Options(a.contig_end_exclusion, percentage(a.min_covered_fraction), (percentage(a.trim_min), percentage(a.trim_max)), exact=True)
    coverage.check_methods(a.methods, o, bool(a.gff), a.command)
    t, flags = thresholds(a)
    if a.methods == ["metabat"]:
        t, flags = METABAT
    if a.methods == ["strobealign-aemb"]:
        return abundance_table(spark, a)
    genomes = genome_map(spark, a)
    rows, contigs, samples = inputs(spark, a, genomes)
    used = usable(rows, t, flags, exact=True)
    placed, mode = contigs, "separator"
    if a.command == "genome":
        if a.single_genome:
            placed = coverage.contigs_as_one(contigs)
        elif a.separator:
            placed = coverage.contigs_by_separator(contigs, a.separator)
        else:
            placed, mode = coverage.contigs_by_map(contigs, genomes), "map"
    if a.methods == ["coverage_histogram"]:
        key = "tid" if a.command == "contig" else "genome"
        hist = coverage.histogram(used, placed if key == "tid" else placed.where("genome is not null"), samples, o, key)
        named = hist.join(contigs.select("tid", "contig").distinct(), "tid") if key == "tid" else hist.withColumnRenamed("genome", "contig")
        return named.join(samples, "sample_idx").select("sample", "contig", "depth", "n_bases").orderBy("sample", "contig", "depth").toDF("Sample", a.command.title(), "Coverage", "Bases")
    trimmed = "trimmed_mean" in a.methods
    if a.gff:
        stats = genes.by_gene(used, genes.placed_genes(text.gff(spark, a.gff, a.gff_feature_type), placed), contigs, samples, o, trimmed)
    elif a.command == "contig":
        stats = coverage.by_contig(used, contigs, samples, o, trimmed)
    else:
        stats = coverage.by_genome(used, placed, samples, o, mode, trimmed)
    names = [(r["sample_idx"], r["sample"]) for r in samples.orderBy("sample_idx").collect()]  # a row per input file
    if a.methods == ["metabat"]:
        return present.metabat(stats, names)
    stats = written(stats, "stats")
    totals = coverage.totals(stats, samples, a.methods)
    final = normalise.normalised(stats, totals, exact=True, divide_first=a.output_format == "dense")
    if a.no_zeros:
        final = coverage.no_zeros(final, a.methods)
    entry = "Gene" if a.gff else a.command.title()
    if "relative_abundance" in a.methods:  # its row of unmapped reads comes first; other metrics do not apply there
        left = normalise.unmapped(totals, exact=True)
        final = final.unionByName(left.drop("sample").selectExpr("*", "cast(null as bigint) as entry_id" if not a.gff else "null as entry_id"), allowMissingColumns=True)
    if a.output_format == "dense":
        return present.dense(final, names, a.methods, entry, as_text=True)
    return present.sparse(final, totals, a.methods, entry, as_text=True)


def write_rows(df: DataFrame, path: str) -> None:
    """A small ordered table as tab-separated text, row by row."""
    out = sys.stdout if path == "-" else open(path, "w", encoding="utf-8")
    try:
        print(*df.columns, sep="\t", file=out)
        for row in df.toLocalIterator():
            print(*("NA" if x is None else x for x in row), sep="\t", file=out)
    finally:
        if path != "-":
            out.close()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    if a.command in ("contig", "genome"):
        write_rows(table_of(spark, a), a.output_file)
    elif a.command == "filter":
        filtered(spark, a)
    elif a.command == "make":
        keep(*mapped(spark, a), a, a.output_directory)
    else:
        write_rows(clusters(spark, a, a.genome_fasta_files).orderBy("representative", "member"), a.output_cluster_definition)
    return 0


if __name__ == "__main__":
    sys.exit(main())
