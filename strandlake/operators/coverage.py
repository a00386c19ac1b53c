"""Coverage statistics of contigs, genomes and genes.

Every statistic is a function of a histogram of depth and a few sums for each entry. One scan of the alignments makes runs of
depth and read counts together; they are added up by (entry, depth) and then become one row per entry, with its histogram as
an array that is as long as there are different depths. Means, moments, trimmed means and histograms are expressions on that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import aligned_with_deletions, identity
from ..functions.numeric import ratio
from ..schema import SECONDARY, SUPPLEMENTARY
from ..scratch import written
from .depth import COUNTS, counted_runs, mapped
from .filters import has

#: Name on the command line -> heading.
METHODS = {
    "mean": "Mean", "trimmed_mean": "Trimmed Mean", "covered_fraction": "Covered Fraction", "covered_bases": "Covered Bases", "variance": "Variance", "length": "Length",
    "count": "Read Count", "reads_per_base": "Reads per base", "anir": "ANIr", "rpkm": "RPKM", "tpm": "TPM", "relative_abundance": "Relative Abundance (%)",
    "strobealign-aemb": "Strobealign aemb",
}
#: These have no notion of a least covered fraction.
_NO_FRACTION = {"count", "length", "reads_per_base", "anir", "strobealign-aemb"}
#: Rows of a histogram that are made from one at a time.
_ROWS = 4096
_ALONE = {"coverage_histogram", "metabat", "strobealign-aemb"}


@dataclass(frozen=True)
class Options:
    end_exclusion: int = 75
    min_covered_fraction: float = 0.0
    trim: tuple[float, float] = (0.05, 0.95)
    exact: bool = False  # 32-bit arithmetic


#: Methods that were added: name -> expression over the one row of an entry, given the options.
_ADDED: dict[str, Callable[[Options], Column]] = {}


def add_method(name: str, heading: str, expression: Callable[[Options], Column], fraction: bool = True) -> None:
    """Make a method known by its name, on the command line too.

    ``expression`` gives a column over what is known of an entry: ``windowed`` and ``bases`` (its bases without and with its ends), ``covered`` and
    ``covered_full``, ``hist`` (depths above 0 with their bases, ascending), ``s1`` and ``s2`` (sums of depth and its square), ``least``, ``reads``, ``identity``. It is
    computed with the other methods, on the same row, so it needs no scan of its own. ``fraction``: whether a least covered fraction may be asked for.
    """
    if name in METHODS or name in _ALONE:
        raise ValueError(f"method {name} is known already")
    METHODS[name] = heading
    _ADDED[name] = expression
    if not fraction:
        _NO_FRACTION.add(name)


def remove_method(name: str) -> None:
    """Undo ``add_method``."""
    _ADDED.pop(name)
    METHODS.pop(name)
    _NO_FRACTION.discard(name)


def share_of_depths(share: float) -> Callable[[Options], Column]:
    """An expression for ``add_method``: the smallest depth that a share of an entry's bases does not exceed (0.5: the median)."""

    def expression(o: Options) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("depth"), (F.col("windowed") - F.col("covered")).cast("bigint").alias("n"))
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("depth"))

        def step(acc: Column, x: Column) -> Column:
            upto = acc["upto"] + x["n"]
            return F.struct(upto.alias("upto"), F.when(acc["depth"].isNull() & (upto >= share * F.col("windowed")), x["depth"]).otherwise(acc["depth"]).alias("depth"))

        return F.coalesce(F.aggregate(F.concat(F.array(zero), F.col("hist")), start, step, lambda acc: acc["depth"]), F.lit(0).cast("bigint")).cast("double")

    return expression


def check_methods(methods: list[str], o: Options, genes: bool = False, grain: str = "contig") -> None:
    """Raise ValueError for methods that do not go together."""
    if not methods:
        raise ValueError("no method is asked for")
    for m in methods:
        if m not in METHODS and m not in _ALONE:
            raise ValueError(f"unknown method {m}")
        if m in _ALONE and len(methods) > 1:
            raise ValueError(f"{m} cannot be combined with other methods")
        if m in _NO_FRACTION and o.min_covered_fraction > 0:
            raise ValueError(f"{m} cannot be used with a minimum covered fraction above 0")
        if m in ("metabat", "strobealign-aemb") and (genes or grain != "contig"):
            raise ValueError(f"{m} is for contigs only")
        if m in ("rpkm", "tpm") and methods.count(m) > 1:
            raise ValueError(f"{m} can be asked for once")
    if "relative_abundance" in methods and grain == "contig" and not genes:
        raise ValueError("relative_abundance is for genomes only")


def samples_of(alignments: DataFrame) -> DataFrame:
    """(sample_idx, sample, num_reads): the samples and their primary records, before any filter. There is a row for each input
    file, so the result is held as a local table and later steps need no further scan."""
    primary = F.when(~has(SECONDARY) & ~has(SUPPLEMENTARY), 1).otherwise(0)
    rows = alignments.groupBy("sample_idx", "sample").agg(F.sum(primary).cast("bigint").alias("num_reads"))
    return local(rows)


def local(small: DataFrame) -> DataFrame:
    """A table of a few rows, computed once."""
    return small.sparkSession.createDataFrame(small.toArrow(), small.schema)


def record_counts(used: DataFrame) -> DataFrame:
    """(sample_idx, tid, *COUNTS): what each record adds to the read counts and identity sums of its contig, in the variants that grains count by."""
    sup, sec = has(SUPPLEMENTARY), has(SECONDARY)
    same = identity(F.col("cigar"), F.col("nm"))
    rows = mapped(used).select("sample_idx", "tid", sup.alias("sup"), sec.alias("sec"), same.alias("same"))
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    same_of = lambda c: F.when(c, F.col("same")).otherwise(0.0)
    first = ~F.col("sup") & ~F.col("sec")
    return rows.select("sample_idx", "tid", F.lit(1).cast("bigint").alias("n_all"), one(~F.col("sup")).alias("n_no_sup"), one(first).alias("n_primary"), same_of(first).alias("same_primary"), same_of(~F.col("sup")).alias("same_no_sup"))


def contig_counts(used: DataFrame) -> DataFrame:
    """Read counts and identity sums of each sample and contig that has a record."""
    return record_counts(used).groupBy("sample_idx", "tid").agg(*(F.sum(c).alias(c) for c in COUNTS))


#: Which reads a grain counts, and of which reads it adds up identities.
_COUNTED = {"contig": ("n_primary", "same_primary"), "separator": ("n_no_sup", "same_primary"), "map": ("n_all", "same_no_sup")}


def _cut(o: Options) -> Column:
    """Bases of a contig without its ends."""
    return F.greatest(F.col("length") - 2 * o.end_exclusion, F.lit(0))


def _cut_unseen(o: Options) -> Column:
    """The same of a contig without reads, which counts whole if its ends would overlap."""
    return F.when(F.col("length") < 2 * o.end_exclusion, F.col("length")).otherwise(_cut(o))


def depth_rows(used: DataFrame, contigs: DataFrame, o: Options, also: Sequence[str] = ()) -> DataFrame:
    """(sample_idx, tid, depth, n_full, n_window, more, *COUNTS, *also): bases of each run of depth, on all of a contig and without its
    ends; and for each record a row (depth 0) with its counts, and once for a sample and contig with how many ``more`` bases count than if it
    had none. ``also`` names columns of ``contigs``."""
    e = o.end_exclusion
    window = F.greatest(F.lit(0), F.least("end", F.col("length") - e) - F.greatest("start", F.lit(e)))
    short = F.col("length") < 2 * e  # these count otherwise once they have a record
    more = F.when(F.col("last") & short, _cut(o) - _cut_unseen(o)).otherwise(0)
    runs = counted_runs(used, contigs, also=also, as_one=short)
    return runs.select("sample_idx", "tid", "depth", (F.col("end") - F.col("start")).alias("n_full"), F.when(F.col("depth") > 0, window).otherwise(0).alias("n_window"), more.alias("more"), *COUNTS, *also)


def summary(rows: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Per entry: moments of the depth, covered bases, ``hist`` (depths above 0 with their bases, ascending) and the ``sums``."""
    by_depth = rows.groupBy(*key, "depth").agg(F.sum("n_full").alias("n_full"), F.sum("n_window").cast("bigint").alias("n"), *(F.sum(c).alias(c) for c in sums))
    d, n = F.col("depth"), F.col("n")
    some = F.when((n > 0) & (d > 0), F.struct("depth", "n"))
    return by_depth.groupBy(*key).agg(
        F.sum(d * n).alias("s1"), F.sum(d * d * n).alias("s2"), F.sum(n).alias("covered"), F.sum("n_full").alias("covered_full"), F.min(F.when((n > 0) & (d > 0), d)).alias("least"),
        F.array_sort(F.collect_list(some)).alias("hist"), *(F.sum(c).alias(c) for c in sums),
    )


_NO_HIST = "array<struct<depth:bigint,n:bigint>>"


def grid_of(entries: DataFrame, samples: DataFrame) -> DataFrame:
    """Every entry in every sample; with several headers (``header`` in both), in those samples whose header has it. With one, samples are an
    array of literals and no join."""
    if "header" in entries.columns:
        return entries.join(samples.select("sample_idx", "header"), "header").drop("header")
    ids = [r["sample_idx"] for r in samples.select("sample_idx").collect()]
    return entries.select("*", F.explode(F.array(*map(F.lit, ids)).cast("array<int>")).alias("sample_idx"))


def _every(entries: DataFrame, rows: DataFrame, samples: DataFrame, key: list[str], reads: str, same: str) -> DataFrame:
    """The summary of every entry in every sample. ``entries`` has bases and windowed (of contigs without reads)."""
    joined = grid_of(entries, samples).join(summary(rows, key, ["more", *COUNTS]), key, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *key, *(c for c in entries.columns if c not in (*key, "bases", "windowed", "header")), (F.col("windowed") + F.coalesce("more", zero)).cast("bigint").alias("windowed"), "bases", F.coalesce(F.col(reads), zero).alias("reads"),
        F.coalesce(F.col(same), F.lit(0.0)).alias("identity"), F.col("n_all").isNotNull().alias("seen"), *(F.coalesce(c, zero).alias(c) for c in ("s1", "s2", "covered", "covered_full")), "least", F.coalesce("hist", F.array().cast(_NO_HIST)).alias("hist"),
    )


def trimmed_mean(o: Options) -> Column:
    """The mean depth of the bases between two shares of the depth order, from ``hist``, ``windowed`` and ``covered``."""
    kind = "float" if o.exact else "double"
    low, high = (F.lit(x).cast(kind) for x in o.trim)
    lo, hi = F.floor(low * F.col("windowed").cast(kind)).cast("bigint"), F.ceil(high * F.col("windowed").cast(kind)).cast("bigint")
    zero = F.struct(F.lit(0).cast("bigint").alias("depth"), (F.col("windowed") - F.col("covered")).cast("bigint").alias("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(False).alias("begun"), F.lit(0).cast("bigint").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        before, upto = acc["before"], acc["before"] + x["n"]
        first = ~acc["begun"] & (upto >= lo)
        part = F.when(first, F.least(upto, hi) - lo + 1).when(acc["begun"] & (upto <= hi), x["n"]).when(acc["begun"] & (before <= hi), hi - before + 1).otherwise(0)
        return F.struct(upto.alias("before"), (acc["begun"] | first).alias("begun"), (acc["total"] + x["depth"] * part).cast("bigint").alias("total"))

    total = F.aggregate(F.concat(F.array(zero), F.col("hist")), start, step, lambda acc: acc["total"])
    return ratio(total, hi - lo, o.exact)


def metrics(every: DataFrame, key: list[str], o: Options, trimmed: bool = True) -> DataFrame:
    """All statistics of each entry, from its summary."""
    x, kind = o.exact, "float" if o.exact else "double"
    B, C, L, Cf = F.col("windowed"), F.col("covered"), F.col("bases"), F.col("covered_full")
    least = F.lit(o.min_covered_fraction).cast(kind)
    zero = F.lit(0.0).cast(kind)
    windowed = lambda v: F.when((B == 0) | (ratio(C, B, x) < least), zero).otherwise(v)
    full = lambda v: F.when((L == 0) | (ratio(Cf, L, x) < least), zero).otherwise(v)
    # Variance about the smallest depth that occurs, which is 0 unless every base is covered.
    k = F.when(C < B, F.lit(0)).otherwise(F.coalesce("least", F.lit(0)))
    ex, ex2 = F.col("s1") - k * B, F.col("s2") - 2 * k * F.col("s1") + k * k * B
    if x:
        square = F.try_divide((ex * ex).cast("float"), B.cast("float")).cast("float")
        variance = F.try_divide((ex2.cast("float") - square).cast("float"), (B - 1).cast("float")).cast("float")
    else:
        variance = F.try_divide(ex2.cast("double") - F.try_divide(ex.cast("double") * ex.cast("double"), B.cast("double")), (B - 1).cast("double"))
    shown = [
        windowed(ratio(F.col("s1"), B, x)).alias("mean"), full(ratio(Cf, L, x)).alias("covered_fraction"), full(Cf.cast(kind)).alias("covered_bases"),
        windowed(F.when(B < 3, zero).otherwise(variance)).alias("variance"), L.cast(kind).alias("length"), F.col("reads").cast(kind).alias("count"), ratio(F.col("reads"), L, x).alias("reads_per_base"),
        ratio(F.col("identity"), F.col("reads"), False).cast(kind).alias("anir"), full(ratio(F.col("reads") * 1_000_000_000, L, x)).alias("rpkm"), full(ratio(F.col("reads"), L, False)).alias("tpm"),
        B.alias("windowed"), C.alias("covered"), L.alias("bases"), windowed(ratio(F.col("s1"), B, x)).alias("relative_abundance"),
    ]
    if trimmed:
        none = (B == 0) | (C == 0) | (ratio(C, B, x) < least)
        shown.append(F.when(none, zero).otherwise(F.coalesce(trimmed_mean(o).cast(kind), zero)).alias("trimmed_mean"))
    return every.select(*key, "seen", "reads", *shown, *(make(o).cast(kind).alias(name) for name, make in _ADDED.items()))


def _header(contigs: DataFrame) -> list[str]:
    return ["header"] if "header" in contigs.columns else []


def _contig_entries(contigs: DataFrame, o: Options) -> DataFrame:
    return contigs.select("tid", F.col("contig").alias("entry"), F.col("length").alias("bases"), _cut_unseen(o).alias("windowed"), *_header(contigs))


def _genome_entries(own: DataFrame, o: Options, key: list[str]) -> DataFrame:
    return own.groupBy(*key, *_header(own)).agg(F.sum("length").cast("bigint").alias("bases"), F.sum(_cut_unseen(o)).cast("bigint").alias("windowed"))


def by_contig(used: DataFrame, contigs: DataFrame, samples: DataFrame, o: Options = Options(), trimmed: bool = True) -> DataFrame:
    """A row per sample and contig, also those without reads: entry_id, entry and all statistics."""
    every = _every(_contig_entries(contigs, o), depth_rows(used, contigs, o), samples, ["sample_idx", "tid"], *_COUNTED["contig"])
    return metrics(every, ["sample_idx", "tid", "entry"], o, trimmed).withColumnRenamed("tid", "entry_id")


def by_genome(used: DataFrame, contigs: DataFrame, samples: DataFrame, o: Options = Options(), mode: str = "map", trimmed: bool = True) -> DataFrame:
    """A row per sample and genome. ``contigs`` has ``genome`` and ``entry_id``; contigs without a genome are left out.

    ``mode``: "map" for a contig map, "separator" for names with a separator and for a single genome; they differ in
    which reads they count.
    """
    # Stored, as it is read twice, and so that its size is known where it meets the alignments.
    own = written(contigs.where("genome is not null"), "own")
    rows = depth_rows(used, own, o, ["entry_id"])
    every = _every(_genome_entries(own, o, ["entry_id", "genome"]), rows, samples, ["sample_idx", "entry_id"], *_COUNTED[mode])
    return metrics(every, ["sample_idx", "entry_id", "genome"], o, trimmed).withColumnRenamed("genome", "entry")


def contigs_by_separator(contigs: DataFrame, separator: str = "~") -> DataFrame:
    """The genome of a contig is its name before the first separator; genomes are in the order of their first contig."""
    named = contigs.withColumn("genome", F.when(F.instr("contig", separator) > 0, F.substring_index("contig", separator, 1)).otherwise(F.raise_error(F.concat(F.lit("no separator in contig name "), "contig"))))
    first = named.groupBy("genome").agg(F.min("tid").cast("bigint").alias("entry_id"))
    return named.join(first, "genome").select(*contigs.columns, "genome", "entry_id")


def contigs_by_map(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    """The genome of a contig as a definition says (genome_idx, genome, contig); null for contigs it does not name."""
    return contigs.join(genomes.select("contig", "genome", F.col("genome_idx").cast("bigint").alias("entry_id")), "contig", "left").select(*contigs.columns, "genome", "entry_id")


def contigs_as_one(contigs: DataFrame, name: str = "genome1") -> DataFrame:
    return contigs.withColumn("genome", F.lit(name)).withColumn("entry_id", F.lit(0).cast("bigint"))


def unassigned_contigs(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    return contigs.join(genomes, "contig", "left_anti")


def absent_contigs(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    return genomes.join(contigs, "contig", "left_anti")


def histogram(used: DataFrame, contigs: DataFrame, samples: DataFrame, o: Options = Options(), key: str = "tid", dense: bool = True) -> DataFrame:
    """(sample_idx, key, depth, n_bases) of entries with reads; ``dense`` fills in depths that do not occur."""
    keys = ["sample_idx", key]
    rows = depth_rows(used, contigs, o, [] if key == "tid" else [key])
    entries = _contig_entries(contigs, o).drop("entry") if key == "tid" else _genome_entries(contigs, o, [key])
    every = _every(entries, rows, samples, keys, *_COUNTED["contig"]).where("seen and windowed > 0")
    kept = every.where(ratio(F.col("covered"), F.col("windowed")) >= o.min_covered_fraction)
    zero = F.struct(F.lit(0).cast("bigint").alias("depth"), (F.col("windowed") - F.col("covered")).cast("bigint").alias("n_bases"))
    if not dense:
        return kept.select(*keys, F.inline(F.concat(F.array(zero), F.transform("hist", lambda x: F.struct(x["depth"].alias("depth"), x["n"].alias("n_bases"))))))
    # Each depth that occurs is a row with the one before it; those between become rows a block at a time, so a very large depth is no large array.
    before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("hist", i - 1)["depth"])
    gaps = kept.select(*keys, F.inline(F.concat(F.array(F.struct(zero["depth"].alias("depth"), zero["n_bases"].alias("n_bases"), F.lit(-1).cast("bigint").alias("before"))), F.transform("hist", lambda x, i: F.struct(x["depth"].alias("depth"), x["n"].alias("n_bases"), before(i).alias("before"))))))
    blocks = gaps.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("depth") - F.col("before") - 1) / _ROWS))).alias("block"))
    first = F.col("before") + 1 + F.col("block") * _ROWS
    every = blocks.select(*keys, F.explode(F.sequence(first, F.least("depth", first + _ROWS - 1))).alias("d"), "depth", "n_bases")
    return every.select(*keys, F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("n_bases")).otherwise(F.lit(0).cast("bigint")).alias("n_bases"))


def no_zeros(stats: DataFrame, methods: list[str]) -> DataFrame:
    """Entries with reads that have a metric above 0."""
    return stats.where(F.greatest(*(F.col(m) for m in methods), F.lit(0.0)) > 0).where("seen")


def aligned_bases(used: DataFrame) -> DataFrame:
    return mapped(used).select("sample_idx", "tid", aligned_with_deletions(F.col("cigar")).alias("aligned"))


def _positive(stats: DataFrame, methods: list[str]) -> Column:
    return F.col("seen") & (F.greatest(*(F.col(m) for m in methods), F.lit(0.0)) > 0)


def totals(stats: DataFrame, samples: DataFrame, methods: list[str]) -> DataFrame:
    """(sample_idx, sample, num_reads, num_mapped, sum_tpm, sum_mean): mapped reads are those of entries with any metric above
    0; the sums, over all entries, are what shares of a sample refer to. A row for each sample, held as a local table. Store ``stats`` first if they
    are used again, or they are made twice."""
    mapped_reads = F.sum(F.when(_positive(stats, methods), F.col("reads"))).alias("num_mapped")
    found = stats.groupBy("sample_idx").agg(mapped_reads, F.sum("tpm").alias("sum_tpm"), F.sum("relative_abundance").alias("sum_mean"))
    return local(samples.join(found, "sample_idx", "left").fillna(0, ["num_mapped"]))
