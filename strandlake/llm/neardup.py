"""Near-duplicates by word shingles: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A signature has ``CHUNKS`` chunks of ``WIDTH`` symbols of 16 bits. Two signatures that differ in fewer than
2 * ``CHUNKS`` symbols differ in at most one symbol of some chunk (pigeonhole), so every chunk is indexed once for each
symbol that may be wrong, by the others. All pairs within that distance meet in a bucket; of pairs further apart but as
similar as the threshold asks, fewer than one in a million meet in none.

A bucket is never expanded into its pairs:

1. Equal sets are one node (the smallest id stands for them).
2. Each member of a bucket is compared by size and signature with the bucket's smallest member. Buckets whose members
   still are apart are cut into tiles of bounded size, none within one large component, large ones with nearly the same
   members together; a tile sends a spanning forest of what sizes and signatures leave possible. The components of this
   coarse graph are families: only within one can there be links.
3. Pairs of the first step are confirmed on full sets. A family that this leaves in several components is cut into tiles
   of at most about 2 * ``TILE`` members; a tile compares the full sets of all its members that are not connected yet,
   and sends the links it finds between components. Two tiles of one large component are never compared.

Components are found by alternating star contractions on stored tables. Nothing but counts reaches the driver. Joins
whose sides grow with the corpus are sort-merge joins at every size.

Defined cases: a text without words (or null) has an empty set, is linked with nothing and is its own component; a row
without an id is never linked, its component is null and it is kept; rows that share an id are one document, linked by any of their texts;
columns besides id and text are ignored (``drop_near_duplicates`` passes them on). Ids are integers of any width; other types
are a ValueError. A very long text is one set, held by one task while it is made or compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.components import components
from .common import in_slices, stored, texts

SHINGLE, PERCENT = 5, 85
CHUNKS, WIDTH = 10, 6
SYMBOLS = CHUNKS * WIDTH
#: Pairs further apart are not compared on full sets. At the threshold (similarity 0.85) 2 in 10^10 pairs are, closer ones
#: still fewer; together with those that meet in no bucket that is fewer than one pair in a million.
FAR = 29
#: Members of a tile come from two groups of about this many.
TILE = 256
#: Buckets of more than ``TILE`` members are united if so many smallest hashes of their members are the same.
ALIKE = 3
SLICE_BYTES = 8 << 20



def _near_signs(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    return (x != y).sum(axis=1) <= FAR


@dataclass(frozen=True)
class Rule:
    """When two sets are linked (least similarity in percent), and when their signatures leave that possible: ``near`` is given those of two
    sides, a row each, and their sizes."""

    percent: int
    sign: type
    near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    def signs(self, column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), self.sign).reshape(len(column), -1)

    def possible(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
        """By sizes, and where these allow it by signatures."""
        ok = 100 * np.minimum(n_x, n_y) >= self.percent * np.maximum(n_x, n_y)
        at = np.flatnonzero(ok)
        ok[at] = self.near(x[at], y[at], n_x[at], n_y[at])
        return ok


NEAR_DUPLICATES = Rule(PERCENT, np.uint16, _near_signs)

_RNG = np.random.default_rng(20240229)
_FACTOR = (_RNG.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes (64 bits) of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = out * _ODD + h[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The b-bit MinHash signatures of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i in range(SYMBOLS):
        y = x * _FACTOR[i] + _SHIFT[i]
        y ^= y >> np.uint32(16)
        out[:, i] = np.minimum.reduceat(y * np.uint32(0x85EBCA6B), starts).astype(np.uint16)
    return out


def bucket_keys(signs: np.ndarray) -> np.ndarray:
    """For each signature the CHUNKS * WIDTH keys: of each chunk, all symbols but one."""
    wide = signs.reshape(len(signs), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(signs), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        h = np.broadcast_to((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1))[None, :], wide.shape[:2]).copy()
        for i in range(WIDTH):
            if i != out:
                h = (h ^ wide[:, :, i]) * _ODD
                h ^= h >> np.uint64(31)
        keys[:, :, out] = h
    return keys.reshape(len(signs), -1).view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, set_id, sign): the size of each document's set, a 128-bit hash of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            sets = [shingles(t) for t in texts(batch.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            signs: list[bytes | None] = [None] * len(sets)
            for i, s in zip(full, signatures([sets[i] for i in full]) if full else ()):
                signs[i] = s.tobytes()
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n", "set_id", "sign"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, set_id binary, sign binary")


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(signs).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], names=["key", "node"])

    return nodes.select("node", "sign").mapInArrow(run, "key long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b), those that sizes and signatures leave possible."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    both = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").where(100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = rule.possible(*(rule.signs(batch.column(i).to_pylist()) for i in (2, 3)), *(batch.column(i).to_numpy() for i in (4, 5)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "sign_a", "sign_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, items): the sets of the wanted documents (node), made again from their texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["id", "items"])

    return rows.mapInArrow(make, "id long, items binary").where("octet_length(items) > 0")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are as similar as asked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


class _Forest:
    """Union of components within a tile; an edge is kept if it joins two."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int, comp_a: int, comp_b: int) -> None:
        x, y = self.root(comp_a), self.root(comp_b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.edges, columns=["a", "b"]).astype("int64")


def _tiles(placed: DataFrame, by: str) -> DataFrame:
    """The members (node, component) of each group ``by``, dealt to tiles (l1, g1, l2, g2) that bring members of different components together.

    A component with ``TILE`` members of a group or more has parts of its own, labelled by it; the others share mixed parts
    (label -1). Two parts of one large component never meet, so a member comes once for each part outside its own
    component: a group that is one component but for a few members costs rows in proportion to its size.
    """
    parts = placed.groupBy(by, "component").agg(F.count("*").alias("size"))
    open_ = parts.groupBy(by).agg(F.count("*").alias("parts")).where("parts > 1").select(by)
    labels = parts.join(open_, by).select(by, "component", "size", F.when(F.col("size") >= TILE, F.col("component")).otherwise(F.lit(-1).cast("long")).alias("label"))
    widths = labels.groupBy(by, "label").agg(F.ceil(F.sum("size") / TILE).cast("int").alias("groups"))
    dealt = labels.join(widths, [by, "label"]).select(by, "component", "label", "groups")
    members = placed.hint("merge").join(dealt, [by, "component"]).select("node", by, "component", "label", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("g"))
    groups = widths.select(by, "label", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    one, two = groups.select(by, F.col("label").alias("l1"), F.col("g").alias("g1")), groups.select(by, F.col("label").alias("l2"), F.col("g").alias("g2"))
    tiles = one.join(two, by).where("(l1 < l2 or (l1 = l2 and g1 <= g2)) and (l1 <> l2 or l1 = -1)")
    sides = F.array_distinct(F.array(F.struct(F.col("l1").alias("label"), F.col("g1").alias("g")), F.struct(F.col("l2").alias("label"), F.col("g2").alias("g"))))
    return members.hint("merge").join(tiles.select(by, "l1", "g1", "l2", "g2", F.inline(sides)), [by, "label", "g"]).select(by, "l1", "g1", "l2", "g2", "node", "component")


def _open_edges(buckets: DataFrame, nodes: DataFrame, comps: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that join members of a bucket in different components where sizes and signatures allow a link."""
    placed = buckets.hint("merge").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    # Buckets with the same members need one look, and large ones with nearly the same members are united: a pair that meets in many of them meets once.
    hashes = lambda seed: F.xxhash64("node", F.lit(seed))
    least = {f"least_{k}": F.min(hashes(k)) for k in range(2, 2 + ALIKE)}
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.bit_xor(hashes(0)).alias("x"), F.bit_xor(hashes(1)).alias("y"), *(c.alias(k) for k, c in least.items())).where("lo <> hi and size > 2")
    group = F.when(F.col("size") > TILE, F.xxhash64(*least)).otherwise(F.col("key"))
    keys = several.groupBy("size", "x", "y", *least).agg(F.min("key").alias("key")).select("key", group.alias("group"))
    open_ = placed.hint("merge").join(keys, "key").select(F.col("group").alias("key"), "node", "component").distinct()
    tiled = _tiles(stored(open_, "open"), "key").hint("merge").join(nodes.select("node", "n", "sign"), "node")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("node", ignore_index=True)
        node, comp, n = (t[c].to_numpy() for c in ("node", "component", "n"))
        sign, forest = rule.signs(list(t["sign"])), _Forest()
        for i in range(len(node)):
            at = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
            for j in at[rule.possible(np.broadcast_to(sign[i], (len(at), sign.shape[1])), sign[at], np.broadcast_to(n[i], len(at)), n[at])]:
                forest.join(node[i], node[j], comp[i], comp[j])
        return forest.frame()

    return tiled.groupBy("key", "l1", "g1", "l2", "g2").applyInPandas(run, "a long, b long").distinct()


def _family_links(families: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on full sets between different components of a family; (node, family) gives the families."""
    placed = families.hint("merge").join(comps, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component"))
    rows = _tiles(placed, "family").hint("merge").join(sets.withColumnRenamed("id", "node"), "node")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("node", ignore_index=True)
        node, comp = (t[c].to_numpy() for c in ("node", "component"))
        items = [np.frombuffer(x, np.uint64) for x in t["items"]]
        size = np.array([len(x) for x in items])
        starts, forest = np.cumsum(np.append(0, size[:-1])), _Forest()
        _, flat = np.unique(np.concatenate(items), return_inverse=True)
        mark = np.zeros(len(flat) + 1, bool)
        for i in range(len(node)):
            if not (comp != comp[i]).any() or not size[i]:
                continue
            own = flat[starts[i] : starts[i] + size[i]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            linked = (comp != comp[i]) & (100 * common >= percent * (size + size[i] - common))
            for j in np.flatnonzero(linked):
                forest.join(node[i], node[j], comp[i], comp[j])
        return forest.frame()

    return rows.select("family", "l1", "g1", "l2", "g2", "node", "component", "items").groupBy("family", "l1", "g1", "l2", "g2").applyInPandas(run, "a long, b long").distinct()


def classes(rows: DataFrame, nodes: DataFrame, buckets: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Each of the ``rows`` (id, n, set_id) with ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept``.

    ``nodes`` are the distinct sets (node: smallest id, set_id, n, sign); ``buckets`` (key, node, pivot: smallest node) bring together all that may be linked.
    """
    kind = docs.schema[id_col].dataType
    # Ids with several texts join their nodes.
    named = rows.where("n > 0 and id is not null")
    twice = named.groupBy("id").agg(F.min(F.xxhash64("set_id")).alias("lo"), F.max(F.xxhash64("set_id")).alias("hi")).where("lo <> hi").select("id")
    of_id = named.join(twice, "id").join(nodes.select("set_id", "node"), "set_id").select("id", "node").distinct()
    same_id = of_id.join(of_id.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    pairs = stored(_likely(buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), nodes, rule), "pairs")
    coarse = components(pairs)
    apart = stored(_open_edges(buckets, nodes, coarse, rule), "edges")
    if not apart.isEmpty():
        coarse = components(apart.union(coarse))
    full = stored(_full_sets(coarse, docs, id_col, text_col), "sets")
    links = stored(_confirmed(pairs, full, rule.percent).union(same_id), "links")
    comps = components(links)
    more = stored(_family_links(coarse.withColumnRenamed("component", "family"), comps, full, rule.percent), "links")
    if not more.isEmpty():
        comps = components(more.union(comps))
    of_set = nodes.hint("merge").join(comps, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    # An empty set has no set_id, and a row without an id no component.
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    return rows.hint("merge").join(of_set, "set_id", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), kept.alias("kept"))


def check_ids(docs: DataFrame, id_col: str) -> None:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"ids must be integers, {id_col} is {kind.simpleString()}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept``."""
    check_ids(docs, id_col)
    rows = stored(sketch(docs, id_col, text_col), "sketch")
    sets = rows.where("n > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    nodes = stored(sets, "nodes")
    keys = _keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    buckets = stored(keys.hint("merge").join(shared, "key"), "buckets")
    return classes(rows, nodes, buckets, docs, NEAR_DUPLICATES, id_col, text_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col)).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti")
