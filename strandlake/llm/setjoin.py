"""Documents whose sets of word shingles are similar (Jaccard): an exact size-aware join.

Two sets are linked if 100 * intersection >= PERCENT * union. Their intersection is then at least ``overlap(n)`` for either size n. Equal
sets are one node first. What brings nodes together depends on their size (Deng, Tao and Li's heavy and light sets):

* **Light sets** enumerate subsets of ``SUBSET`` shingles. Shingles are ordered by how many sets have them, rare ones
  first; a set of which r shingles are shared with any other set needs to take the first ``r - least + SUBSET`` only, as two linked sets
  have ``least`` of their shared shingles in common and so ``SUBSET`` of these first ones (``least``: see ``shared_least``).
* **Heavy sets** are found by inverted lists: each stands in the lists of its first ``r - least + 1`` shingles, as do the light ones that are large
  enough to be linked with a heavy one, and what a list has is compared.
* **The boundary** between them is the size with the least cost: rows of subsets below it, and above it entries of lists, each counted with
  the mean length of a list. Sizes and lists are counted over all documents; the result is the same with any boundary.

Of heavy sets, only the window of the smallest hashes is sent, about 0.3 of the set: linked sets have a tenth of their size and
``MARGIN`` more in common there. A shingle of one set only can't link anything, and a set with too few others (less than ``shared_least``) has no links; so most
documents are done after one count of shingles. No row is made for a pair of a list or of a subset: members are compared with the smallest
one, and lists whose members still are apart are cut into tiles, by the machinery of ``neardup``. There, pairs are left out by size and by a
lower bound of the difference (shingles counted by 256 hash cells), which never leaves out a link, and the rest is confirmed on full sets. So every
pair that is linked meets, up to equal 64-bit hashes of different shingles.

Defined cases: a text without words (or null) has an empty set, is linked with nothing and is its own component; a row without an id is never
linked and its component is null; rows that share an id are one document, linked by any of their texts; columns besides id and text are
ignored, whatever their names; an empty table gives an empty one. Ids are integers of any width, other types are a ValueError. A very long text is one
set, held by one task while it is made or compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored, texts
from .neardup import SLICE_BYTES, Rule, check_ids, classes, shingles

PERCENT = 80
SUBSET = 2
#: Sets below this size are sent whole and may be light; those above are heavy and send a window.
MOST_LIGHT = 64
#: Shingles that windows of linked sets have in common: a tenth of their size and so many more. Passages that many texts share are seldom that long.
MARGIN = 12
#: Cells in which the shingles of a set are counted, up to 255 each.
CELLS = 256


def overlap(n: int) -> int:
    """The smallest intersection that a set of this size has with a set it is linked with."""
    return -(-PERCENT * n // 100)


def window(n: int) -> int:
    """How many shingles, those with the smallest hashes, a set of this size sends."""
    return n if n < MOST_LIGHT else n - overlap(n) + n // 10 + MARGIN


def shared_least(n: int) -> int:
    """How many shingles two linked sets, one of them of this size, have in common within their windows, at least.

    Two sets that share o shingles share at least o - (n - w) of the first w of one with n, if the other has as many; both windows leave
    their own margin, so it is the smaller one that counts.
    """
    own = overlap(n) - (n - window(n))
    if 100 * n < PERCENT * MOST_LIGHT:  # sets it may be linked with are sent whole, too
        return own
    smallest = max(MOST_LIGHT, overlap(n))
    return min(own, overlap(smallest) - (smallest - window(smallest)))


def _near_cells(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The difference of two linked sets is at most (100 - PERCENT) / (100 + PERCENT) of both sizes together."""
    apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n_x + n_y)


LINKED = Rule(PERCENT, np.uint8, _near_cells)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, set_id, sign, first): the size of each document's set, a 128-bit hash of it, its counts by cell, and its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            sizes, ids, signs, firsts = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                # The middle bits tell cells, so that a window, which has the smallest hashes, is spread over them.
                signs.append(np.minimum(np.bincount((s >> np.uint64(24)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes() if len(s) else None)
                firsts.append(s[: window(len(s))].tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (ids, signs, firsts))], names=["id", "n", "set_id", "sign", "first"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, set_id binary, sign binary, first binary")


def _items(nodes: DataFrame) -> DataFrame:
    """(item, node): the shingles of the windows, a row each. Sets of fewer than four are linked with equal ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                each = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in each]))], names=["item", "node"])

    return nodes.where("n >= 4").select("node", "first").mapInArrow(run, "item long, node long")


def _least(n: Column) -> Column:
    """``shared_least`` as an expression."""
    least = lambda m: F.ceil(m * PERCENT / 100) - m + F.when(m < MOST_LIGHT, m).otherwise(m - F.ceil(m * PERCENT / 100) + F.floor(m / 10) + MARGIN)
    own, smallest = least(n), F.greatest(F.lit(MOST_LIGHT), F.ceil(n * PERCENT / 100))
    return F.when(n * 100 < PERCENT * MOST_LIGHT, own).otherwise(F.least(own, least(smallest))).cast("int")


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The size from which on sets are heavy, by cost. ``sizes`` says how many sets there are of each size below ``MOST_LIGHT``."""

    def cost(x: int) -> float:
        light = sum(k * math.comb(n - overlap(n) + SUBSET, SUBSET) for n, k in sizes.items() if n < x)
        return light + sum(k * (n - overlap(n) + 1) * mean_list for n, k in sizes.items() if 100 * n >= PERCENT * x)

    return min(range(5, MOST_LIGHT + 1), key=cost)


def buckets_of(nodes: DataFrame, at: int | None = None) -> DataFrame:
    """(key, node, pivot): the subsets of light and the lists of heavy sets that several nodes have, with the smallest of these. ``at`` sets the boundary."""
    items = _items(nodes)
    several = items.groupBy("item").agg(F.count("*").alias("lists")).where("lists > 1")
    shared = items.hint("merge").join(several, "item")
    # As many as a set's window has, at most; of these only the first ones are used.
    listed = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("lists", "item"))).alias("all")).hint("merge").join(nodes.select("node", "n"), "node")
    enough = listed.withColumn("least", _least(F.col("n"))).where("size(all) >= least")
    open_ = stored(enough.select("node", "n", "least", F.slice("all", 1, F.size("all") - F.col("least") + SUBSET).alias("first"), (F.size("all") - F.col("least") + 1).alias("lists")), "shared")
    if at is None:
        facts = open_.agg(F.sum(F.aggregate("first", F.lit(0.0), lambda a, x: a + x["lists"])).alias("all"), F.sum(F.size("first")).alias("n")).first()
        small = {r["n"]: r["count"] for r in open_.where(F.col("n") < MOST_LIGHT).groupBy("n").count().collect()}  # fewer rows than MOST_LIGHT
        at = boundary(small, facts["all"] / facts["n"] if facts["n"] else 1.0)
    two = F.flatten(F.transform("first", lambda x, k: F.transform(F.slice("first", k + 2, F.size("first")), lambda y: F.xxhash64(F.least(x["item"], y["item"]), F.greatest(x["item"], y["item"])))))
    of_light = open_.where((F.col("n") < at) & (F.col("least") >= SUBSET)).select("node", F.explode(two).alias("key"))
    of_heavy = open_.where(100 * F.col("n") >= PERCENT * at).select("node", F.explode(F.slice("first", 1, F.col("lists"))).alias("x")).select("node", F.xxhash64("x.item").alias("key"))
    keys = stored(of_light.union(of_heavy), "keys")
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last")
    return stored(keys.hint("merge").join(pivots, "key"), "buckets")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: int | None = None) -> DataFrame:
    """Each row with ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept``."""
    check_ids(docs, id_col)
    rows = stored(sketch(docs, id_col, text_col), "sketch")
    sets = rows.where("n > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("n", "sign", "first")))
    nodes = stored(sets, "nodes")
    return classes(rows.drop("sign", "first"), nodes.drop("first"), buckets_of(nodes, at), docs, LINKED, id_col, text_col)
