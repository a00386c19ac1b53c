"""Periodic runs of words in documents: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q, at least ``max(min_length, min_exponent * q)`` words long, that can't be
made longer on either side. It overlaps itself, moved by q, on ``length - q`` words, so at least on

    k = min over q of max(min_length, min_exponent * q) - q

words (5 with the defaults). Every word of a run therefore lies within a k-gram that the document has twice. Words outside such
k-grams are masked; a run lies within one stretch of the others, and it is maximal there if it is in the document. Most
documents have no such stretch and end here.

A surviving stretch is halved again and again (Main and Lorentz). A run that crosses the middle has more than half of its words on
one side, so for its period q the words next to the middle on that side come again q words on. Such q are looked up, and for each the
run is what extends to both sides. A half that lies within a run of period 3 or less can't have others and is not looked at. Extensions are
compared directly where few periods are possible and read from Z arrays where many are, so n words cost O(n log n).

Words are compared as text, not as hashes. Each document is worked on alone, within one task; nothing is shuffled.

Defined cases: a null or empty text has no words and no runs, its collapsed text is empty; rows with a null or repeated id are rows
like any other; an empty table gives an empty one; columns besides id and text are ignored, whatever their names. A very long text
is held by one task with about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, texts

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE_BYTES = 8 << 20
#: With more possible periods than this at one middle, Z arrays are made.
FEW = 16


def least_overlap(min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> int:
    """The fewest words on which a run overlaps itself, moved by its period."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def surviving(x: np.ndarray, k: int, min_length: int) -> list[tuple[int, int]]:
    """The stretches (start, end) of words within k-grams that occur twice or more, at least ``min_length`` long."""
    n = len(x)
    if n < max(k + 1, min_length):
        return []
    # Ranks of 2-, 4-, 8-grams and so on fit in 32 bits, so two of them make one number: no hashing.
    grams, width = x, 1
    while width < k:
        step = min(width, k - width)
        m = len(grams) - step
        _, grams = np.unique(grams[:m] << 32 | grams[step : step + m], return_inverse=True)
        width += step
        if width < k and len(grams) and grams.max() + 1 == len(grams):  # every gram is the only one, longer ones are too
            return []
    again = np.bincount(grams)[grams] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    inside = np.concatenate(([0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]))
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2]) if b - a >= min_length]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two arrays are equal, looked at in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differs = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = at + step, step * 4
    return n


def _z(x: list[int]) -> list[int]:
    """For each place, how far what begins there equals the beginning."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and x[m] == x[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def _beyond(x: np.ndarray, lo: int, mid: int, hi: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(q, s, e) for periods q after which the words behind ``mid`` come again: the stretch of period q around it within lo and hi."""
    if len(periods) <= FEW:
        return [(q, mid - _agree(x[lo:mid][::-1], x[lo : mid + q][::-1]), mid + q + _agree(x[mid : hi - q], x[mid + q : hi])) for q in periods.tolist()]
    most = int(periods[-1])
    ahead = _z(x[mid:hi].tolist())
    # Behind: the words before mid, backwards, and those that end q words later, backwards; the first of them end at mid + most.
    back = _z([*x[lo:mid][::-1].tolist(), -1, *x[lo : mid + most][::-1].tolist()])
    return [(q, mid - back[mid - lo + 1 + most - q], mid + q + ahead[q]) for q in periods.tolist()]


def _crossing(x: np.ndarray, lo: int, mid: int, hi: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Stretches (q, s, e) of period q <= most around ``mid``, within lo and hi, with two words or more that come again on one side: a run of five words
    or more has three on one side, one of period q >= 2 has 2 * q there."""
    right = x[mid : min(mid + most + 2, hi)]
    if len(right) >= 3:
        yield from _beyond(x, lo, mid, hi, 1 + np.flatnonzero((right[1:-1] == right[0]) & (right[2:] == right[1])))
    left = x[max(mid - most - 2, lo) : mid][::-1]
    if len(left) >= 3:
        mirrored = _beyond(x[lo:hi][::-1], 0, hi - mid, hi - lo, 1 + np.flatnonzero((left[1:-1] == left[0]) & (left[2:] == left[1])))
        yield from ((q, lo + hi - (lo + e), lo + hi - (lo + s)) for q, s, e in mirrored)


def runs_within(x: np.ndarray, lo: int, hi: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """The runs (start, length, period) of ``x[lo:hi]``."""
    found: set[tuple[int, int, int]] = set()
    first, last, open_ = lo, hi, [(lo, hi)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < min_length:
            continue
        mid, best, within = (lo + hi) // 2, {}, False
        for q, s, e in _crossing(x, lo, mid, hi, (hi - lo) // min_exponent):
            if e - s >= max(min_length, min_exponent * q):
                best[s, e] = min(q, best.get((s, e), q))  # multiples of the smallest period span the same words
                within |= q < min_exponent and s == lo and e == hi
        for (s, e), q in best.items():
            # What goes on beyond this part is found where it is whole.
            if not (s == lo > first and x[s - 1] == x[s - 1 + q]) and not (e == hi < last and x[e] == x[e - q]):
                found.add((s, e - s, q))
        if not within:
            open_ += [(lo, mid), (mid, hi)]
    return found


def runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a document's words, by start and period."""
    x = numbered(words)
    found: set[tuple[int, int, int]] = set()
    for lo, hi in surviving(x, least_overlap(min_length, min_exponent), min_length):
        found |= runs_within(x, lo, hi, min_length, min_exponent)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep) if k] if found else words


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: ``runs`` are structs of start, length and period by start and period, and ``collapsed`` is the
    text with one period of each run, its words joined by single spaces."""
    if min_length < 5 or min_exponent < 4:
        raise ValueError("runs are at least five words long and hold their period four times or more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            sizes, every, short = [], [], []
            for text in texts(batch.column(1)):
                words = text.encode("utf-8", "surrogatepass").split()  # bytes: the six ASCII spaces
                found = runs(words, min_length, min_exponent)
                sizes.append(len(words))
                every.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                short.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(every, kind), pa.array(short, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    shown = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {shown}").withColumnRenamed("id", id_col)
