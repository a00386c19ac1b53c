"""Registered queries over the test-bed alignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from ..operators import coverage as cov
from ..operators import cluster, depth, genes, normalise, present, shard
from ..operators.coverage import Options
from ..operators.filters import METABAT, Flags, Thresholds, has, pair_filter, single_filter, threshold_filter, usable
from ..operators.setjoin import sharing, similar_pairs
from ..schema import ALIGNMENTS, UNMAPPED
from ..scratch import new_folder, shuffles_let_go, written
from ..sources import binary, files, text
from ..sources.headers import Headers
from ..streaming.incremental import CoverageState, WindowState
from . import testbed

Query = Callable[[SparkSession, str], DataFrame]
DEFAULT = Flags()
#: Decimal places of shares of a sample; other metrics are shown to 9.
PLACES = {"rpkm": 6, "tpm": 6, "relative_abundance": 6}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    alns = testbed.alignments(spark, sf_dir)
    return alns, testbed.contigs(spark, sf_dir), cov.samples_of(alns)


def _shown(stats: DataFrame, samples: DataFrame, methods: list[str]) -> DataFrame:
    named = stats.join(samples.select("sample_idx", "sample"), "sample_idx")
    return named.select("sample", "entry", *(F.round(F.col(m).cast("double"), PLACES.get(m, 9)).alias(m) for m in methods))


def _contig(methods: list[str], o: Options = Options(), t: Thresholds = Thresholds(), flags: Flags = DEFAULT, drop_zeros: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        alns, contigs, samples = _inputs(spark, sf_dir)
        stats = cov.by_contig(usable(alns, t, flags), contigs, samples, o, trimmed="trimmed_mean" in methods)
        if {"rpkm", "tpm"} & {*methods}:
            stats = written(stats, "stats")
            stats = normalise.normalised(stats, cov.totals(stats, samples, methods))
        return _shown(cov.no_zeros(stats, methods) if drop_zeros else stats, samples, methods)

    return run


def _genome_stats(spark: SparkSession, sf_dir: str, mode: str, o: Options, trimmed: bool = False) -> tuple[DataFrame, DataFrame]:
    alns, contigs, samples = _inputs(spark, sf_dir)
    placed = {
        "map": lambda: cov.contigs_by_map(contigs, testbed.genomes(spark, sf_dir)),
        "separator": lambda: cov.contigs_by_separator(contigs),
        "single": lambda: cov.contigs_as_one(contigs),
    }[mode]()
    return cov.by_genome(usable(alns, Thresholds(), DEFAULT), placed, samples, o, "map" if mode == "map" else "separator", trimmed), samples


def _genome(methods: list[str], mode: str, o: Options = Options()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats, samples = _genome_stats(spark, sf_dir, mode, o, "trimmed_mean" in methods)
        if {"rpkm", "tpm", "relative_abundance"} & {*methods}:
            stats = written(stats, "stats")
            stats = normalise.normalised(stats, cov.totals(stats, samples, methods))
        return _shown(stats, samples, methods)

    return run


def genome_relative_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: abundance, depth and covered share of each genome in each sample."""
    return _genome(["relative_abundance", "mean", "covered_fraction"], "separator", Options(min_covered_fraction=0.1))(spark, sf_dir)


def genome_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, samples = _genome_stats(spark, sf_dir, "separator", Options())
    return normalise.unmapped(cov.totals(stats, samples, ["mean"])).select("sample", "entry", F.round("relative_abundance", 6).alias("relative_abundance"))


def sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, contigs, samples = _inputs(spark, sf_dir)
    stats = cov.by_contig(usable(alns, Thresholds(), DEFAULT), contigs, samples, trimmed=False)
    return cov.totals(stats, samples, ["mean"]).select("sample", "num_reads", "num_mapped")


def contig_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, contigs, samples = _inputs(spark, sf_dir)
    hist = cov.histogram(usable(alns, Thresholds(), DEFAULT), contigs, samples)
    return hist.join(samples, "sample_idx").join(contigs, "tid").select("sample", F.col("contig").alias("entry"), "depth", "n_bases")


def contig_metabat(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, contigs, samples = _inputs(spark, sf_dir)
    stats = cov.by_contig(usable(alns, *METABAT), contigs, samples, trimmed=False)
    table = present.metabat(stats, [(0, "A"), (1, "N"), (2, "R")])
    return table.select("contigName", "contigLen", "totalAvgDepth", *(F.col(f"`{n}.bam{v}`").alias(f"{n}_bam{v.replace('-', '_')}") for n in "ANR" for v in ("", "-var")))


def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, contigs, samples = _inputs(spark, sf_dir)
    stats = cov.by_contig(usable(alns, Thresholds(), DEFAULT), contigs, samples, trimmed=False)
    wide = present.dense(stats, [(0, "A"), (1, "N"), (2, "R")], ["mean", "covered_bases"])
    return wide.select(F.col("Contig").alias("contig"), *(F.round(F.col(f"`{n} {h}`"), 6).alias(f"{n}_{m}") for n in "ANR" for h, m in (("Mean", "mean"), ("Covered Bases", "covered_bases"))))


def depth_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, contigs, samples = _inputs(spark, sf_dir)
    segs = depth.merged_segments(depth.segments(usable(alns, Thresholds(), DEFAULT), contigs, bin_size=256), bin_size=256)
    return segs.join(samples, "sample_idx").select("sample", "tid", "start", "end", "depth")


def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testbed.alignments(spark, sf_dir)
    return rows.select("sample", "tid", F.inline(cigar.blocks(F.col("cigar"), F.col("pos")))).groupBy("sample", "tid").agg(F.count("*").alias("n_blocks"), F.sum("s").alias("sum_s"), F.sum("e").alias("sum_e"))


def _genes(methods: list[str], by_genome: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        alns, contigs, samples = _inputs(spark, sf_dir)
        named = cov.contigs_by_map(contigs, testbed.genomes(spark, sf_dir)) if by_genome else contigs
        placed = genes.placed_genes(testbed.genes(spark, sf_dir), named)
        stats = genes.by_gene(usable(alns, Thresholds(), DEFAULT), placed, contigs, samples, trimmed="trimmed_mean" in methods)
        return _shown(stats, samples, methods)

    return run


def _counted(kept: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = kept(testbed.alignments(spark, sf_dir))
        return rows.groupBy("sample", "tid").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.sum("nm").alias("sum_nm"), F.sum(F.when(has(UNMAPPED), 1).otherwise(0)).alias("n_unmapped"))

    return run


def _sharded(alns: DataFrame) -> DataFrame:
    """Each read against two halves of the reference; what lies in the other half is unmapped there."""
    sides = alns.where("tid is not null").withColumn("shard", F.explode(F.array(F.lit(0), F.lit(1))))
    here = F.col("tid") % 2 == F.col("shard")
    return sides.withColumn("flag", F.when(here, F.col("flag")).otherwise(F.col("flag").bitwiseOR(4))).withColumn("align_score", F.when(here, F.col("align_score"))).withColumn("tid", F.when(here, F.floor(F.col("tid") / 2).cast("int")))


def _shards(excluded: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        alns, contigs, _ = _inputs(spark, sf_dir)
        halves = contigs.select((F.col("tid") % 2).alias("shard"), F.floor(F.col("tid") / 2).cast("int").alias("tid"), "contig", "length")
        out = None
        if excluded:
            out = shard.excluded_contigs(halves, spark.range(1).select(F.lit(excluded).alias("genome")))
        first = alns.withColumn("flag", F.col("flag").bitwiseOR(F.lit(64)))
        best = shard.best_shard(_sharded(first), halves, out)
        names = shard.merged_contigs(halves).select("tid", "contig")
        return best.where(~has(UNMAPPED)).join(names, "tid").groupBy("sample", "contig").agg(F.count("*").alias("n"), F.sum("align_score").alias("score"))

    return run


def definition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cov.contigs_by_map(testbed.contigs(spark, sf_dir), testbed.genomes(spark, sf_dir))
    return placed.groupBy("genome").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


def unassigned_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.unassigned_contigs(testbed.contigs(spark, sf_dir), testbed.genomes(spark, sf_dir)).select("contig", "length")


def _as_text(df: DataFrame, columns: list[Column | str], path: str, mode: str = "error", packed: str = "none") -> str:
    """Write rows as tab-separated lines."""
    cols = [F.lit(c) if isinstance(c, str) else c.cast("string") for c in columns]
    with shuffles_let_go(df.sparkSession):
        df.select(F.concat_ws("\t", *cols).alias("value")).write.mode(mode).option("compression", packed).text(path)
    return path


def _sam_header(contigs: DataFrame, order: str, path: str) -> str:
    """The header of a SAM folder, in as many files as sorting makes ranges; the names of files tell their order, which is all that readers go by."""
    return _as_text(contigs.orderBy(order), ["@SQ", F.concat(F.lit("SN:"), "contig"), F.concat(F.lit("LN:"), "length")], path)


def _sam_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The test-bed alignments as SAM text, a folder per sample."""
    root = new_folder(spark, "sam")
    names = testbed.contigs(spark, sf_dir)
    alns = testbed.alignments(spark, sf_dir).join(names.select("tid", "contig"), "tid")
    c = F.col
    fields = [c("qname"), c("flag"), c("contig"), c("pos") + 1, c("mapq"), c("cigar"), "=", c("mpos") + 1, c("tlen"), "*", "*", F.concat(F.lit("NM:i:"), c("nm")), F.concat(F.lit("AS:i:"), c("align_score"))]
    out = []
    for sample in ("A", "N", "R"):
        path = _sam_header(names, "tid", f"{root}/{sample}.sam")
        out.append(_as_text(alns.where(F.col("sample") == sample), fields, path, "append"))
    return out


def source_sam_contig_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig_mean`` by way of SAM files."""
    paths = _sam_files(spark, sf_dir)
    alns, headers = text.sam_and_headers(spark, paths)
    samples = headers.samples(cov.samples_of(alns))
    return _shown(cov.by_contig(usable(alns, Thresholds(), DEFAULT), headers.contigs, samples, trimmed=False), samples, ["mean"])


def _own_header(contigs: DataFrame, k: int) -> DataFrame:
    """Two thirds of the contigs, other ones and in another order for each sample k, with their ``place``."""
    order = [F.col("tid"), -F.col("tid"), F.pmod(F.col("tid").cast("bigint") * 7919, F.lit(1009)) * (1 << 31) + F.col("tid")][k]
    return files.numbered(contigs.where(F.col("tid") % 3 != k), order, "place").withColumn("place", F.col("place").cast("int"))


def _mixed_sam(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Headers]:
    """Three samples as SAM files with different headers."""
    root, contigs = new_folder(spark, "mixed-sam"), testbed.contigs(spark, sf_dir)
    alns, c, paths = testbed.alignments(spark, sf_dir), F.col, []
    for k, sample in enumerate("ANR"):
        own = _own_header(contigs, k)
        path = _sam_header(own, "place", f"{root}/{sample}.sam")
        fields = [c("qname"), c("flag"), c("contig"), c("pos") + 1, c("mapq"), c("cigar"), "=", c("mpos") + 1, c("tlen"), "*", "*", F.concat(F.lit("NM:i:"), c("nm")), F.concat(F.lit("AS:i:"), c("align_score"))]
        paths.append(_as_text(alns.where(c("sample") == sample).join(own.select("tid", "contig"), "tid"), fields, path, "append"))
    return text.sam_and_headers(spark, paths)


def _mixed_bam(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Headers]:
    """The same as BAM files, whose records hold numbers of their own header."""
    root, contigs, alns, paths = new_folder(spark, "mixed-bam"), testbed.contigs(spark, sf_dir), testbed.alignments(spark, sf_dir), []
    for k, sample in enumerate("ANR"):
        own = _own_header(contigs, k)
        rows = alns.where(F.col("sample") == sample).join(own.select("tid", "place"), "tid").withColumns({"tid": F.col("place"), "mtid": F.col("place")}).drop("place")
        paths.append(f"{root}/{sample}.bam")
        binary.write_bam(rows, own.select(F.col("place").alias("tid"), "contig", "length"), paths[-1])
    return binary.bam_and_headers(spark, paths, 1 << 20)


def _mixed(read: Callable[[SparkSession, str], tuple[DataFrame, Headers]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        alns, headers = read(spark, sf_dir)
        samples = headers.samples(cov.samples_of(alns))
        return _shown(cov.by_contig(usable(alns, Thresholds(), DEFAULT), headers.contigs, samples, trimmed=False), samples, ["mean", "covered_bases", "length"])

    return run


def headers_dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contig of any header; what a sample's own header does not have is 0 there."""
    alns, headers = _mixed_sam(spark, sf_dir)
    stats = cov.by_contig(usable(alns, Thresholds(), DEFAULT), headers.contigs, headers.samples(cov.samples_of(alns)), trimmed=False)
    wide = present.dense(stats, [(0, "A"), (1, "N"), (2, "R")], ["mean"])
    return wide.select(F.col("Contig").alias("contig"), *(F.round(F.col(f"`{n} Mean`"), 6).alias(f"{n}_mean") for n in "ANR"))


def headers_genome_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes are made of the contigs that a sample's own header has."""
    alns, headers = _mixed_sam(spark, sf_dir)
    samples = headers.samples(cov.samples_of(alns))
    stats = cov.by_genome(usable(alns, Thresholds(), DEFAULT), cov.contigs_by_separator(headers.contigs), samples, mode="separator", trimmed=False)
    return _shown(stats, samples, ["mean", "length"])


def _tagged(read: str) -> Query:
    """Sums of two tags that nothing else reads, of records that pass a filter: by way of SAM, or of BAM files that are written whole, filtered and
    written again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, names, c = new_folder(spark, "tagged"), testbed.contigs(spark, sf_dir), F.col
        alns = testbed.alignments(spark, sf_dir).join(names.select("tid", "contig"), "tid")
        more = [F.concat(F.lit("XS:i:"), c("seq_len")), F.concat(F.lit("RG:Z:group"), c("mapq") % 5)]
        fields = [c("qname"), c("flag"), c("contig"), c("pos") + 1, c("mapq"), c("cigar"), "=", c("mpos") + 1, c("tlen"), F.expr("repeat('A', seq_len)"), "*", F.concat(F.lit("NM:i:"), c("nm")), F.concat(F.lit("AS:i:"), c("align_score")), *more]
        path = _sam_header(names, "tid", f"{root}/all.sam")
        _as_text(alns, fields, path, "append", "gzip")
        passing = Thresholds(identity=0.95)
        if read == "sam":
            rows = threshold_filter(text.sam(spark, path, more=["tags"]), passing)
        else:
            whole, headers = text.sam_and_headers(spark, [path], ["line"])
            binary.write_bam(whole, headers.contigs, f"{root}/all.bam")
            kept, _ = binary.bam_and_headers(spark, [f"{root}/all.bam"], 1 << 20, "raw")
            binary.write_bam(threshold_filter(kept, passing), f"{root}/all.bam", f"{root}/kept.bam")
            rows, _ = binary.bam_and_headers(spark, [f"{root}/kept.bam"], 1 << 20, "tags")
        return rows.groupBy(c("tags")["RG"].alias("read_group")).agg(F.count("*").alias("n"), F.sum(c("tags")["XS"].cast("long")).alias("sum_xs"), F.sum("nm").alias("sum_nm"))

    return run


def source_gff_gene_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene_mean`` by way of a GFF file."""
    c = F.col
    fields = [c("contig"), "testbed", c("feature"), c("start") + 1, c("end"), ".", "+", "0", F.concat(F.lit("ID="), "gene_id")]
    path = _as_text(testbed.genes(spark, sf_dir), fields, new_folder(spark, "gff"))
    alns, contigs, samples = _inputs(spark, sf_dir)
    stats = genes.by_gene(usable(alns, Thresholds(), DEFAULT), genes.placed_genes(text.gff(spark, path), contigs), contigs, samples, trimmed=False)
    return _shown(stats, samples, ["mean", "covered_fraction", "covered_bases"])


def source_definition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``definition_join`` by way of a definition file."""
    path = _as_text(testbed.genomes(spark, sf_dir), [F.col("genome"), F.col("contig")], new_folder(spark, "definition"))
    placed = cov.contigs_by_map(testbed.contigs(spark, sf_dir), text.definition(spark, path))
    return placed.groupBy("genome").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


def source_bam_contig_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig_mean`` by way of BAM files, a folder per sample, read in splits."""
    root, (alns, contigs, _) = new_folder(spark, "bam"), _inputs(spark, sf_dir)
    paths = [f"{root}/{sample}.bam" for sample in "ANR"]
    for sample, path in zip("ANR", paths):
        binary.write_bam(alns.where(F.col("sample") == sample), contigs, path)
    read, headers = binary.bam_and_headers(spark, paths, 1 << 20)
    samples = headers.samples(cov.samples_of(read))
    return _shown(cov.by_contig(usable(read, Thresholds(), DEFAULT), headers.contigs, samples, trimmed=False), samples, ["mean"])


def source_fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lengths of contigs by way of a FASTA file."""
    path = new_folder(spark, "fasta")
    seq = F.regexp_replace(F.expr("repeat('ACGTN', cast(length / 5 as int))"), "(.{70})", "$1\n")
    testbed.contigs(spark, sf_dir).select(F.concat(F.lit(">"), "contig", F.lit(" made\n"), seq).alias("value")).write.text(path)
    return text.fasta_contigs(spark, path).select("contig", "length")


def source_quality_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes that are complete and clean enough, by way of a quality table; those without a quality are left out."""
    path, genomes = new_folder(spark, "quality"), testbed.genomes(spark, sf_dir).select("genome", "genome_idx").distinct()
    made = genomes.where("genome_idx % 5 <> 0").select(F.col("genome").alias("Bin Id"), (F.col("genome_idx") + 40).alias("Completeness"), (F.col("genome_idx") % 7).alias("Contamination"))
    made.write.csv(path, sep="\t", header=True)
    return text.good_genomes(genomes, text.quality(spark, path), 60.0, 4.0).select("genome")


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[CoverageState, DataFrame]:
    """The state after a stream of alignments whose segments have been merged and whose last batch has been run again, and the samples."""
    alns, contigs, samples = _inputs(spark, sf_dir)
    stored = new_folder(spark, "stream-input")
    alns.repartition(10).write.parquet(stored)
    state = CoverageState(new_folder(spark, "stream-state"), contigs, DEFAULT, fan=2)
    stream = spark.readStream.schema(ALIGNMENTS).option("maxFilesPerTrigger", 2).parquet(stored)
    state.start(stream, new_folder(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    state.add(alns, state.sums.cover()[-1][1])
    return state, samples.select("sample_idx", "sample")


def stream_incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read counts of contigs, added up by micro-batches of a stream."""
    state, samples = _streamed(spark, sf_dir)
    return state.counts().join(samples, "sample_idx").select("sample", "tid", "n_all", "n_no_sup", "n_primary")


def stream_incremental_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal depth, from changes of depth added up by micro-batches of a stream."""
    state, samples = _streamed(spark, sf_dir)
    return depth.merged_segments(state.segments()).join(samples, "sample_idx").select("sample", "tid", "start", "end", "depth")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of an hour, from a stream whose batches are in no order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    stored = new_folder(spark, "events-input")
    events.repartition(6).write.parquet(stored)
    state = WindowState(spark, new_folder(spark, "events-state"), "1 hour", fan=2)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(stored)
    state.start(stream, new_folder(spark, "events-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return state.windows().select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(start AS timestamp_ntz))").alias("start_s"), "event_type", "n", F.col("total").cast("double").alias("total"))


def contig_added_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods that are not built in, beside one that is."""
    added = {"median_depth": 0.5, "depth_of_ninety": 0.9}
    for name, share in added.items():
        cov.add_method(name, name, cov.share_of_depths(share))
    try:
        return _contig(["mean", *added])(spark, sf_dir)
    finally:
        for name in added:
            cov.remove_method(name)


#: Least Jaccard index of documents that are candidates, and words of a shingle.
DOCUMENTS_ALIKE, DOCUMENT_SHINGLE = 0.5, 3


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")


def _shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, items): the set of shingles of each document."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # Split at what is between words, which takes much less time than to extract them; there is an empty part before or after it at the ends.
    words = F.array_remove(F.split(F.translate("text", upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    # In an array of its own, so that words are found once and not again for each shingle.
    rows = docs.select("doc_id", "n_chars", F.explode(F.array(words)).alias("w")).where(F.size("w") >= DOCUMENT_SHINGLE)
    # By places, as a slice of an array takes as long as the whole array.
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - DOCUMENT_SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(DOCUMENT_SHINGLE))))
    return rows.select("doc_id", "n_chars", F.sort_array(F.array_distinct(shingles)).alias("items"))


def _document_sets(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(id, size, items): the distinct sets of shingles of all documents, or of those of ``only`` (doc_id), each told by its smallest doc_id; ``size`` is its longest
    text's."""
    docs = _documents(spark, sf_dir)
    sets = _shingled(docs if only is None else docs.join(only, "doc_id", "left_semi"))
    return sets.groupBy("items").agg(F.min("doc_id").alias("id"), F.max("n_chars").alias("size"))


def _sharing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, may) of every document that has a set, stored: whether another one may have the same set or one that is alike."""
    sets = _shingled(_documents(spark, sf_dir)).select(F.col("doc_id").alias("id"), "items")
    return written(sharing(sets, DOCUMENTS_ALIKE).withColumnRenamed("id", "doc_id"), "sharing")


def _document_pairs(sets: DataFrame) -> DataFrame:
    return similar_pairs(sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item")), DOCUMENTS_ALIKE)


def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different sets of shingles that are alike, by the join that finds similar genomes."""
    sets = _document_sets(spark, sf_dir, _sharing_documents(spark, sf_dir).where("may"))
    return _document_pairs(sets).select("a", "b", F.col("common").cast("long").alias("common"), F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"))


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set with its representative: longer texts come first, and the most similar representative is taken."""
    known = _sharing_documents(spark, sf_dir)
    sets = written(_document_sets(spark, sf_dir, known.where("may")), "document-sets")
    pairs = _document_pairs(sets)
    edges = pairs.select("a", "b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("ani"))
    # A document that is like no other is a set of its own, of which nothing but its size is needed.
    alone = _documents(spark, sf_dir).join(known.where("not may"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    every = sets.select("id", "size").union(alone)
    return cluster.representatives(every.select(F.col("id").alias("genome"), F.struct((-F.col("size")).alias("size"), "id").alias("order")), edges)


_ALL = ["mean", "trimmed_mean", "covered_fraction", "covered_bases", "variance", "length", "count", "reads_per_base", "anir"]

QUERIES: dict[str, Query] = {
    "genome_relative_abundance": genome_relative_abundance,
    "contig_mean": _contig(["mean"]),
    "contig_mean_no_exclusion": _contig(["mean"], Options(end_exclusion=0)),
    "contig_trimmed_mean": _contig(["trimmed_mean"]),
    "contig_histogram": contig_histogram,
    "contig_covered_fraction": _contig(["covered_fraction"]),
    "contig_covered_bases": _contig(["covered_bases"]),
    "contig_variance": _contig(["variance"]),
    "contig_length": _contig(["length"]),
    "contig_count": _contig(["count"]),
    "contig_reads_per_base": _contig(["reads_per_base"]),
    "contig_anir": _contig(["anir"]),
    "contig_rpkm": _contig(["rpkm"]),
    "contig_tpm": _contig(["tpm"]),
    "contig_metabat": contig_metabat,
    "contig_all_methods": _contig(_ALL),
    "contig_added_methods": contig_added_methods,
    "contig_no_zeros": _contig(["mean", "covered_bases"], drop_zeros=True),
    "contig_min_covered_fraction": _contig(["mean", "covered_fraction", "variance"], Options(min_covered_fraction=0.5)),
    "contig_thresholds": _contig(["mean", "count"], t=Thresholds(identity=0.95, mapq=20)),
    "contig_proper_pairs": _contig(["mean", "count"], flags=Flags(improper=False, supplementary=False)),
    "genome_mean_map": _genome(["mean"], "map"),
    "genome_mean_separator": _genome(["mean"], "separator"),
    "genome_single": _genome(_ALL, "single"),
    "genome_unmapped": genome_unmapped,
    "genome_trimmed_mean": _genome(["trimmed_mean"], "map"),
    "genome_variance": _genome(["variance"], "map"),
    "genome_rpkm": _genome(["rpkm"], "separator"),
    "genome_tpm": _genome(["tpm"], "separator"),
    "genome_count_map_mode": _genome(["count", "anir"], "map"),
    "gene_mean": _genes(["mean", "covered_fraction", "covered_bases"]),
    "gene_count": _genes(["count", "reads_per_base", "anir", "length"]),
    "gene_genome_mean": _genes(["mean", "variance"], by_genome=True),
    "filter_flags": _counted(lambda a: a.where(Flags(improper=False, supplementary=False).keep())),
    "filter_single_identity": _counted(lambda a: threshold_filter(a, Thresholds(identity=0.95))),
    "filter_single_length": _counted(lambda a: threshold_filter(a, Thresholds(length=60))),
    "filter_aligned_percent": _counted(lambda a: threshold_filter(a, Thresholds(aligned=0.96))),
    "filter_mapq": _counted(lambda a: threshold_filter(a, Thresholds(mapq=30))),
    "filter_pairs": _counted(lambda a: pair_filter(a, Thresholds(pair_length=90, pair_identity=0.93, identity=0.9))),
    "filter_pairs_inverse": _counted(lambda a: pair_filter(a, Thresholds(pair_length=90, pair_identity=0.93), inverse=True)),
    "filter_inverse": _counted(lambda a: single_filter(a, Thresholds(identity=0.95), inverse=True)),
    "filter_proper_pairs": _counted(lambda a: pair_filter(a, Thresholds())),
    "shard_best_hit": _shards(None),
    "shard_excluded": _shards("Brand#11"),
    "sample_totals": sample_totals,
    "dense_matrix": dense_matrix,
    "depth_segments": depth_segments,
    "cigar_blocks": cigar_blocks,
    "cluster_candidates": cluster_candidates,
    "cluster_representatives": cluster_representatives,
    "definition_join": definition_join,
    "unassigned_contigs": unassigned_contigs,
    "source_sam_contig_mean": source_sam_contig_mean,
    "headers_sam_contig_mean": _mixed(_mixed_sam),
    "headers_bam_contig_mean": _mixed(_mixed_bam),
    "headers_dense_matrix": headers_dense_matrix,
    "headers_genome_mean": headers_genome_mean,
    "source_sam_tags": _tagged("sam"),
    "source_bam_tags": _tagged("bam"),
    "source_gff_gene_mean": source_gff_gene_mean,
    "source_definition_join": source_definition_join,
    "source_bam_contig_mean": source_bam_contig_mean,
    "source_fasta_contigs": source_fasta_contigs,
    "source_quality_genomes": source_quality_genomes,
    "stream_incremental_counts": stream_incremental_counts,
    "stream_incremental_depth": stream_incremental_depth,
    "stream_event_windows": stream_event_windows,
}
