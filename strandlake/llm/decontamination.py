"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a slice of a task's documents. Its words become numbers (words that no benchmark item has are 0 and match
nothing), and its suffixes are sorted by their first ``window`` words. Suffixes that do not begin with enough words of the
benchmark are left out, as no search could end at them. Every test suffix, that is every window of every item, is
binary-searched in each shard. Hits that continue each other on both sides join to longest verbatim matches with
their places.

Items are held by every task, in blocks: Spark sums their sizes first, and each block has about ``BLOCK_BYTES`` of text
at most (or one item); further blocks are further passes, so no item is left out. Between passes the documents are
written and the block is let go, so one block is held at a time. Documents are never shuffled.

Defined cases: a null or empty text has no words and no hits; an item without words is found nowhere; one with fewer words
than the window is one window as a whole; equal item ids count once, a null id is the text "null"; repeated rows are
each searched; columns besides id and text are passed on by ``decontaminate`` and ignored by ``search``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored, texts, words_of

BLOCK_BYTES = 32 << 20
SHARD_BYTES = 12 << 20


class TestIndex:
    """The windows of a block of items as sorted keys of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids, self.vocab = window, [i for i, _ in items], {}
        keys, item_of, at, size = [], [], [], []
        for n, (_, text) in enumerate(items):
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            width = min(window, len(seq))
            for j in range(len(seq) - width + 1 if seq else 0):
                keys.append(seq[j : j + width] + [0] * (window - width))
                item_of.append(n), at.append(j), size.append(width)
        self.keys = packed(np.array(keys, np.uint32).reshape(-1, window))
        self.item, self.at, self.size = (np.array(x, np.int64) for x in (item_of, at, size))
        self.least = int(self.size.min()) if len(size) else 0
        # The end of the range of suffixes that begin with a key: a short key is padded by the largest number.
        tops = np.array(keys, np.uint32).reshape(-1, window)
        tops[np.arange(window)[None, :] >= self.size[:, None]] = 0xFFFFFFFF
        self.tops = packed(tops)


def packed(numbers: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(numbers.astype(">u4")).view(f"S{4 * numbers.shape[1]}").ravel()


def suffix_array(seq: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their places) of the suffixes of ``seq`` that begin with ``least`` numbers above 0."""
    n = len(seq)
    gaps = np.flatnonzero(seq == 0)
    places = np.arange(n)
    after = np.append(gaps, n)[np.searchsorted(gaps, places)]  # the next 0
    places = places[after - places >= least]
    grid = np.append(seq, np.zeros(window, seq.dtype))[places[:, None] + np.arange(window)[None, :]]
    grid[(after[places] - places)[:, None] <= np.arange(window)[None, :]] = 0
    keys = packed(grid)
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def matches(docs: list[str], index: TestIndex) -> tuple[list[int], list[list[tuple[int, int, int, int]]]]:
    """For each document its number of words and its longest matches: (item, place, place in the item, words)."""
    seqs, counts, number = [], [], index.vocab.get
    for text in docs:
        found = words_of(text)
        counts.append(len(found))
        seqs.append(np.fromiter((number(w, 0) for w in found), np.uint32, len(found)))
        seqs.append(np.zeros(1, np.uint32))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    if not index.least or not docs:
        return counts, out
    starts = np.cumsum([0, *(c + 1 for c in counts)])
    keys, places = suffix_array(np.concatenate(seqs), index.window, index.least)
    first, last = np.searchsorted(keys, index.keys, "left"), np.searchsorted(keys, index.tops, "right")
    n = last - first
    if not n.sum():
        return counts, out
    test = np.repeat(np.arange(len(n)), n)
    place = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    item, at, size = index.item[test], index.at[test], index.size[test]
    order = np.lexsort((place, place - at, item))
    item, at, size, place = item[order], at[order], size[order], place[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(item)) - 1
    doc = np.searchsorted(starts, place[begin], "right") - 1
    for d, i, p, j, w in zip(doc, item[begin], place[begin] - starts[doc], at[begin], place[end] + size[end] - place[begin]):
        out[d].append((int(i), int(p), int(j), int(w)))
    return counts, out


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places the spans (place, length) cover."""
    total, reach = 0, 0
    for start, length in sorted(spans):
        total += max(0, start + length - max(start, reach))
        reach = max(reach, start + length)
    return total


_MATCH = "array<struct<item_id:string,doc_start:int,item_start:int,n_words:int>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))


def blocks(items: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks of bounded size, each sent to the tasks, and whether it is the last one.

    A block is let go when the next one is asked for: its pass must be over then.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        shared = items.sparkSession.sparkContext.broadcast(TestIndex(sorted((r["id"], r["text"]) for r in part.collect()), window))
        yield shared, k == n - 1
        if k < n - 1:
            shared.unpersist()


def search(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document with ``n_words``, ``n_hit`` (words inside any match) and ``matches``."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast(_MATCH).alias("matches"))
    for part, last in blocks(items, window, item_id, item_text):
        found = found.mapInArrow(_pass(part, last), f"id {kind}, text string, matches {_MATCH}, n_words long, n_hit long")
        if not last:
            found = stored(found.select("id", "text", "matches"), "matches")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "matches")


def _pass(shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in in_slices(batches, "text", SHARD_BYTES):
            counts, got = matches(texts(batch.column(1)), index)
            rows = [(before or []) + [{"item_id": index.ids[i], "doc_start": p, "item_start": j, "n_words": w} for i, p, j, w in more] for before, more in zip(batch.column(2).to_pylist(), got)]
            hits = [covered([(m["doc_start"], m["n_words"]) for m in r]) for r in rows]
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(rows, _MATCH_TYPE), pa.array(counts, pa.int64()), pa.array(hits, pa.int64())], names=["id", "text", "matches", "n_words", "n_hit"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no window of any item."""

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, text_col, SHARD_BYTES):
                got = matches(texts(batch.column(batch.schema.get_field_index(text_col))), shared.value)[1]
                yield batch.filter(pa.array([not m for m in got], pa.bool_()))

        return run

    for part, last in blocks(items, window, item_id, item_text):
        docs = docs.mapInArrow(clean(part), docs.schema)
        docs = docs if last else stored(docs, "clean")
    return docs
