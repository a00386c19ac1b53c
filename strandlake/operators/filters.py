"""Row filters over alignments: flags, thresholds of single reads, and thresholds of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import aligned_with_deletions, aligned_without_deletions
from ..functions.numeric import single
from ..schema import PROPER, SECONDARY, SUPPLEMENTARY, UNMAPPED


def has(flag: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(flag)) != 0


@dataclass(frozen=True)
class Flags:
    """Which records take part: by default all but secondary ones."""

    improper: bool = True
    secondary: bool = False
    supplementary: bool = True

    def keep(self) -> Column:
        out = F.lit(True)
        if not self.secondary:
            out &= ~has(SECONDARY)
        if not self.supplementary:
            out &= ~has(SUPPLEMENTARY)
        if not self.improper:
            out &= has(PROPER)
        return out


@dataclass(frozen=True)
class Thresholds:
    """Least aligned length, identity and aligned share of single reads and of pairs, and least mapping quality (255: off)."""

    length: int = 0
    identity: float = 0.0
    aligned: float = 0.0
    pair_length: int = 0
    pair_identity: float = 0.0
    pair_aligned: float = 0.0
    mapq: int = 255

    @property
    def on(self) -> bool:
        return self.any_single or self.any_pair or self.mapq != 255

    @property
    def any_single(self) -> bool:
        return self.length > 0 or self.identity > 0 or self.aligned > 0

    @property
    def any_pair(self) -> bool:
        return self.pair_length > 0 or self.pair_identity > 0 or self.pair_aligned > 0

    def modes(self, improper: bool) -> tuple[bool, bool]:
        """(test single reads, test pairs)."""
        by_mapq = self.mapq != 255
        one = self.any_single or (not self.any_pair and by_mapq)
        return one, self.any_pair or ((not one or not improper) and by_mapq)


#: Thresholds and flags under which depth tables for binning are made.
METABAT = (Thresholds(identity=0.97001), Flags(improper=True, secondary=True, supplementary=True))


def _mapq_ok(mapq: Column, least: int) -> Column:
    return F.lit(True) if least == 255 else (mapq >= least) & (mapq != 255)


def single_ok(t: Thresholds, exact: bool = False) -> Column:
    """Whether a read passes; deletions count as aligned, and a read that aligns nothing fails."""
    aligned = aligned_with_deletions(F.col("cigar"))
    share = F.try_divide(single(aligned, exact), single(F.col("seq_len"), exact))
    same = single(F.lit(1) - single(F.try_divide(single(F.col("nm"), exact), single(aligned, exact)), exact), exact)
    ok = _mapq_ok(F.col("mapq"), t.mapq) & (aligned > 0) & (aligned >= t.length) & (single(share, exact) >= single(F.lit(t.aligned), exact)) & (same >= single(F.lit(t.identity), exact))
    return F.coalesce(ok, F.lit(False))


def flag_filter(alignments: DataFrame, flags: Flags) -> DataFrame:
    return alignments.where(flags.keep())


def single_filter(alignments: DataFrame, t: Thresholds, flags: Flags = Flags(), inverse: bool = False, exact: bool = False) -> DataFrame:
    """Mapped reads that pass; inverse: unmapped reads and those that fail. Flags hold either way."""
    used = alignments.where(flags.keep())
    mapped = ~has(UNMAPPED)
    return used.where(~mapped | ~single_ok(t, exact)) if inverse else used.where(mapped & single_ok(t, exact))


def pair_filter(alignments: DataFrame, t: Thresholds, improper: bool = False, inverse: bool = False, exact: bool = False) -> DataFrame:
    """Both mates of pairs that pass; without deletions in the aligned length.

    Mates are primary, proper and on one contig, matched by name within sample and contig in the order of position. A
    mate without the other is dropped. Inverse: pairs that fail, unmapped reads and improper pairs.
    """
    one, _ = t.modes(improper)
    primary = alignments.where(~has(SECONDARY) & ~has(SUPPLEMENTARY))
    paired = primary.where(~has(UNMAPPED) & has(PROPER) & (F.col("mtid") == F.col("tid")))
    facts = paired.withColumn("_aligned", aligned_without_deletions(F.col("cigar"))).withColumn("_one", single_ok(Thresholds(t.length, t.identity, t.aligned, mapq=t.mapq), exact) if one else F.lit(True)).withColumn("_q", _mapq_ok(F.col("mapq"), t.mapq))
    key = ["sample_idx", "tid", "qname"]
    row = F.struct(*facts.columns)
    # A name has two records on a contig; should it have more, they pair up two by two in the order of position.
    listed = facts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "flag", row.alias("row")))).alias("rows"))
    couples = listed.where(F.size("rows") >= 2).select("rows", F.explode(F.sequence(F.lit(1), F.floor(F.size("rows") / 2).cast("int"))).alias("k"))
    two = couples.select(F.element_at("rows", F.col("k") * 2 - 1)["row"].alias("a"), F.element_at("rows", F.col("k") * 2)["row"].alias("b"))
    aligned = F.col("a._aligned") + F.col("b._aligned")
    share = F.try_divide(single(aligned, exact), single(F.col("a.seq_len") + F.col("b.seq_len"), exact))
    same = single(F.lit(1) - single(F.try_divide(single(F.col("a.nm") + F.col("b.nm"), exact), single(aligned, exact)), exact), exact)
    ok = (
        F.col("a._q") & F.col("b._q") & F.col("a._one") & F.col("b._one") & (aligned > 0) & (aligned >= t.pair_length)
        & (single(share, exact) >= single(F.lit(t.pair_aligned), exact)) & (same >= single(F.lit(t.pair_identity), exact))
    )
    ok = F.coalesce(ok, F.lit(False))
    chosen = two.where(~ok if inverse else ok).select(F.explode(F.array("a", "b")).alias("r")).select("r.*").select(*alignments.columns)
    if inverse:
        chosen = chosen.unionByName(primary.where(has(UNMAPPED) | ~has(PROPER)))
    return chosen


def threshold_filter(alignments: DataFrame, t: Thresholds, flags: Flags = Flags(), inverse: bool = False, exact: bool = False) -> DataFrame:
    """The filter that the thresholds ask for: of single reads only, or of pairs (also where none is set)."""
    one, pairs = t.modes(flags.improper)
    if one and not pairs:
        return single_filter(alignments, t, flags, inverse, exact)
    return pair_filter(alignments, t, flags.improper, inverse, exact)


def usable(alignments: DataFrame, t: Thresholds, flags: Flags, exact: bool = False) -> DataFrame:
    """What coverage counts: records that pass the thresholds, if any is set, and then the flags."""
    return flag_filter(threshold_filter(alignments, t, flags, exact=exact) if t.on else alignments, flags)
