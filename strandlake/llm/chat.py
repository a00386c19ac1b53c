"""Chat formatting: cumulative snapshots of conversations collapse to the longest, which are then rendered.

A logged conversation whose turns begin another, longer one is a snapshot of it. Every prefix of a conversation has a
128-bit hash: the exclusive-or of the hashes of (place, role, text) of its turns, which rolls from turn to turn. Whole
conversations are anti-joined with the hashes of all shorter prefixes; of equal ones, the smallest id stays.

Rolling is done in two levels, within blocks of ``BLOCK`` turn numbers and over the blocks of a conversation, so that a
conversation with a large part of all rows is many small groups. Both sides of the anti-join are made distinct
first, so a frequent first turn is one row there. Rendered text comes in parts of ``PART`` turns.

Everything is DataFrame expressions.

Defined cases: repeated rows (equal conversation, turn, role and text) count once; turns with equal numbers are ordered
by role and text; a null turn counts as -1, a null role as "unknown", a null text as empty; rows without a
conversation id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, PART = 256, 1024
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & a[c].eqNullSafe(b[c])
    return out


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv, block, place, role, text): the turns of each conversation, numbered from 1."""
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv", "block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"))
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "role", "text")))
    return local.join(offsets, _same(local, offsets, "conv", "block")).select(local["conv"], local["block"], (F.col("offset") + F.col("rank")).alias("place"), "role", "text")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """(conv, place, x, y, whole): the hash of each prefix; ``whole`` marks that of the whole conversation."""
    one = placed.select("conv", "block", "place", F.xxhash64("place", "role", "text").alias("x"), F.xxhash64("text", "role", "place", F.lit(1)).alias("y"))
    sums = one.groupBy("conv", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.max("place").alias("last"))
    by_block = Window.partitionBy("conv").orderBy("block")
    ahead = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(ahead), F.lit(0)).alias(c) for c in ("bx", "by")), F.when(F.lead("block").over(by_block).isNull(), F.col("last")).alias("end"))
    rolling = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = one.select("conv", "block", "place", F.bit_xor("x").over(rolling).alias("x"), F.bit_xor("y").over(rolling).alias("y"))
    joined = local.join(carried, _same(local, carried, "conv", "block"))
    return joined.select(local["conv"], "place", F.col("x").bitwiseXOR(F.col("bx")).alias("x"), F.col("y").bitwiseXOR(F.col("by")).alias("y"), (F.col("place").eqNullSafe(F.col("end"))).alias("whole"))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv): the conversations that begin no longer one, one for each content."""
    hashes = prefix_hashes(placed)
    wholes = hashes.where("whole").groupBy("place", "x", "y").agg(F.min("conv").alias("conv"))
    shorter = hashes.where("not whole").select("place", "x", "y").distinct()
    return wholes.join(shorter, ["place", "x", "y"], "left_anti").select("conv")


def render(turns: DataFrame, template: str = TURN, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations; the parts of one, in order, are its whole text.

    ``turns`` has conv_id, turn, role and text.
    """
    placed = placed_turns(turns)
    kept = maximal(placed)
    rows = placed.join(kept, _same(placed, kept, "conv"), "left_semi")
    before, between, after = template.replace("{text}", "{role}").split("{role}")
    line = F.concat(F.lit(before), "role", F.lit(between), "text", F.lit(after))
    parts = rows.groupBy("conv", F.floor((F.col("place") - 1) / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return parts.select(F.col("conv").alias("conv_id"), "part", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
