"""Packing of tokenised documents into sequences of a fixed capacity: matching of large items, then best fit.

The plan depends on nothing but how many pieces have each length, and a length is at most the capacity. So Spark
counts the lengths, the driver packs the *counts* (at most ``capacity`` numbers, however large the corpus is), and Spark
deals the plan's slots out to the pieces by their rank within their length. A task numbers its own pieces of each length as
it makes them; what other tasks have before is a running sum over counts, so no piece is ranked by a sort, however
frequent its length is. Token ids move once at most, as bytes, and no Python reads them again.

- Pieces above a third of the capacity: at most two fit a sequence. Each takes, from the longest down, the longest
  partner that still fits.
- Smaller pieces, from the longest down, go to the smallest gap that holds them.

Defined cases: a null or empty text is one piece of length 1 (the end-of-document id); repeated rows are packed each
on its own; a null id is kept; an empty table gives an empty result; columns besides id and text are ignored. A very long
text is encoded as a whole and cut by its ids; one with a very long run of white space takes the file's own tokenizer, as
the faster encoder's split pattern cannot read it.
"""

from __future__ import annotations

import functools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, stored, texts

#: Bytes of text that a task holds at a time.
SLICE_BYTES = 4 << 20

#: The split pattern of byte-level BPE vocabularies of this kind (a fixed, published value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these scripts, Unicode tables of different libraries may differ; such texts go to the reference tokenizer.
_RARE = re.compile("[^\x00-ԯ‐-⁞€]")
#: Running counts of at most so many (task, length) pairs, of some 180 bytes each when hashed, are sent to all tasks; of more,
#: they meet the pieces in a shuffle.
MOST_SENT = 100_000
#: A split pattern that tries a white-space run from its end needs stack for each character of the run.
_LONG_SPACE, _LONG_RUN = re.compile(r"(?<!\s)\s{10000}"), 10_000


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a text to its ids, equal to those of the ``tokenizers`` file at ``path``.

    Common scripts take a faster encoder with the same ranks; everything else takes the file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    plain = spec["pre_tokenizer"] or {}
    fits = spec["model"]["type"] == "BPE" and plain.get("type") == "ByteLevel" and not plain["add_prefix_space"] and plain.get("use_regex", True) and not spec["normalizer"]
    if not fits:
        return lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("pieces", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        rare = any(x in text for x in special) or not text.isascii() and _RARE.search(text)
        if rare or len(text) > _LONG_RUN and _LONG_SPACE.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and cut: a row per piece with (id, task, nth, piece, start, length, ids).

    A document is its ids and then ``end_id``. Only one longer than ``capacity`` is cut; its first piece takes what
    the full pieces leave over. ``nth`` numbers the pieces of equal length that a task makes. ``ids`` are
    little-endian unsigned 32-bit numbers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, task, seen = _encoder(tokenizer), np.array([end_id], np.uint32), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in in_slices(batches, "text", SLICE_BYTES):
            rows, nth, piece, start, length, data = [], [], [], [], [], []
            for row, text in enumerate(texts(batch.column(1))):
                ids = np.concatenate([encode(text), tail]).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row), nth.append(seen[b - a]), piece.append(k), start.append(a), length.append(b - a), data.append(ids[a:b].tobytes())
                    seen[b - a] += 1
            numbers = (pa.array(nth, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.full(len(rows), task, np.int64)), *numbers, pa.array(data, pa.binary())],
                names=["id", "task", "nth", "piece", "start", "length", "ids"],
            )

    schema = f"id {id_type}, task long, nth long, piece int, start long, length long, ids binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Pack ``counts[length]`` pieces of each length: (number of sequences, lengths in each), first to last."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    third, open_runs, done = capacity // 3, defaultdict(list), []

    def put(n: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        (open_runs[gap] if gap else done).append((n, lengths))

    for big in range(capacity, third, -1):
        while left[big]:
            mate = min(big, capacity - big)
            while mate > third and left[mate] < (2 if mate == big else 1):
                mate -= 1
            if mate <= third:
                n, lengths = left[big], [big]
            else:
                n, lengths = (left[big] // 2 if mate == big else min(left[big], left[mate])), [big, mate]
            for length in lengths:
                left[length] -= n
            put(int(n), lengths)
    for small in range(third, 0, -1):
        gap = small
        while left[small]:
            while gap < capacity and not open_runs[gap]:
                gap += 1
            n, lengths = open_runs[gap].pop() if gap < capacity else (int(left[small]), [])
            each = min(gap // small, int(left[small]))
            used = min(n, int(left[small]) // each)
            left[small] -= used * each
            if n > used and lengths:
                open_runs[gap].append((n - used, lengths))
            put(used, lengths + [small] * each)
            gap = small if capacity - sum(lengths) - small * each >= small else gap
    return done + [run for runs in open_runs.values() for run in runs]


def slots(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """The plan as slots: for each length (first, sequence, offset), ascending. Pieces of that length ranked ``first`` and
    on go to sequences ``sequence`` and on, at ``offset``."""
    taken, sequence = defaultdict(int), 0
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for n, run in plan(counts, capacity):
        offset = 0
        for length in run:
            out[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces (id, piece, start, length, ids) of all documents with ``sequence_id`` and the ``offset`` within it,
    gapless from 0. ``ids`` are little-endian unsigned 32-bit numbers, as ``numpy.frombuffer`` reads them."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    made = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select("task", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    if made.count() <= MOST_SENT:
        before = F.broadcast(before)
    # A row per length; together a few slots a length, however many pieces there are.
    dealt = [(length, [*map(list, runs)]) for length, runs in slots(counts, capacity).items()]
    plans = F.broadcast(spark.createDataFrame(dealt, "length long, slots array<array<long>>"))
    rank = F.col("nth") + F.col("before")
    ranked = pieces.join(before, ["task", "length"]).join(plans, "length").withColumn("rank", rank)
    slot = F.try_element_at(F.filter("slots", lambda x: x[0] <= F.col("rank")), F.lit(-1))
    placed = ranked.withColumn("slot", slot)
    sequence = F.col("slot")[1] + F.col("rank") - F.col("slot")[0]
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids", sequence.alias("sequence_id"), F.col("slot")[2].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Join the pieces of each sequence (at most ``capacity`` ids): (sequence_id, ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"])).alias("ids"))


def digested(packed: DataFrame) -> DataFrame:
    """The same rows with ``ids_crc32`` (of the ids as little-endian 32 bits) in the place of ``ids``."""
    return packed.select(*(F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in packed.columns))
