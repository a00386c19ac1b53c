"""CIGAR strings as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string; empty for "*" and null."""
    parts = F.coalesce(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.substring(x, -1, 1).alias("op")))


def length_of(ops: Column, kinds: str) -> Column:
    """The summed lengths of those of the operations that ``kinds`` names."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])


def total_of(cigar: Column, kinds: str) -> Column:
    return length_of(operations(cigar), kinds)


def aligned_with_deletions(cigar: Column) -> Column:
    return total_of(cigar, "MID=X")


def aligned_without_deletions(cigar: Column) -> Column:
    return total_of(cigar, "MI=X")


#: Longer CIGARs are walked in parts, as each block of a part is copied for those behind it.
PART = 256


def _walk(ops: Column, at: Column) -> Column:
    """struct<at, out, aligned> of operations from ``at`` on."""
    blank = F.array().cast("array<struct<s:bigint,e:bigint>>")
    start = F.struct(at.cast("bigint").alias("at"), blank.alias("out"), F.lit(0).cast("bigint").alias("aligned"))

    def step(acc: Column, x: Column) -> Column:
        covers, moves, counts = x["op"].isin("M", "=", "X"), x["op"].isin("M", "=", "X", "D", "N"), x["op"].isin("M", "=", "X", "D", "I")
        more = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + x["n"]).alias("e"))))
        to, aligned = F.when(moves, acc["at"] + x["n"]).otherwise(acc["at"]), F.when(counts, acc["aligned"] + x["n"]).otherwise(acc["aligned"])
        return F.struct(to.alias("at"), F.when(covers, more).otherwise(acc["out"]).alias("out"), aligned.alias("aligned"))

    return F.aggregate(ops, start, step)


def _walk_in_parts(ops: Column, at: Column) -> Column:
    """The same for many operations: parts are walked from 0 on, and moved to where the ones before them end."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ops) - 1) / PART).cast("int")), lambda i: _walk(F.slice(ops, i * PART + 1, PART), F.lit(0)))
    start = F.struct(at.cast("bigint").alias("at"), F.array().cast("array<struct<by:bigint,out:array<struct<s:bigint,e:bigint>>>>").alias("parts"), F.lit(0).cast("bigint").alias("aligned"))

    def step(acc: Column, x: Column) -> Column:
        placed = F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("by"), x["out"].alias("out"))))
        return F.struct((acc["at"] + x["at"]).alias("at"), placed.alias("parts"), (acc["aligned"] + x["aligned"]).alias("aligned"))

    def done(acc: Column) -> Column:
        out = F.flatten(F.transform(acc["parts"], lambda p: F.transform(p["out"], lambda b: F.struct((b["s"] + p["by"]).alias("s"), (b["e"] + p["by"]).alias("e")))))
        return F.struct(acc["at"].alias("at"), out.alias("out"), acc["aligned"].alias("aligned"))

    return F.aggregate(parts, start, step, done)


def walked(cigar: Column, pos: Column) -> Column:
    """struct<at, out, aligned>: where the alignment ends, its half-open reference blocks that M, = and X cover from 0-based ``pos`` on (D and N move on without
    covering; I, S, H and P do neither), and its length with insertions and deletions, in one walk over the operations."""
    # An operation has two characters or more. Many of them are bound to a variable, or they would be made again for each part.
    many = F.transform(F.array(operations(cigar)), lambda ops: _walk_in_parts(ops, pos))
    return F.when(F.coalesce(F.length(cigar), F.lit(0)) <= 2 * PART, _walk(operations(cigar), pos)).otherwise(F.get(many, F.lit(0)))


def blocks(cigar: Column, pos: Column) -> Column:
    """array<struct<s, e>>: the blocks of ``walked``."""
    return walked(cigar, pos)["out"]


def identity_of(ops: Column, nm: Column) -> Column:
    """(aligned - edit distance) / aligned, with insertions and deletions in the aligned length; 0 if nothing aligns."""
    aligned = length_of(ops, "MID=X")
    return F.when(aligned > 0, (aligned - nm) / aligned).otherwise(F.lit(0.0))


def identity(cigar: Column, nm: Column) -> Column:
    return identity_of(operations(cigar), nm)
