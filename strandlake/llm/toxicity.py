"""Toxicity: a cumulative-link (ordinal logistic) model of severity grades over sparse word features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all thresholds, ordered cuts. x_j is log(1 + count) of a
vocabulary word; one more feature says whether any is there. Weights are not negative. The severity of a document is the
expected grade, and it is toxic if P(grade >= 1) is at least half.

Labels say only toxic or not. Grades are made from them: 0 for clean documents; toxic ones get 1 to ``GRADES`` - 1 by a
two-grade model that was fitted without them (each half of the sample is scored by the model of the other half), cut at
equal parts of the toxic documents that have vocabulary words. So a grade says how sure a model is that has not seen the label.

Fitting uses a bounded sample, the ``fit_rows`` labelled documents first by a hash of their id; of these, Spark counts
in how many toxic and clean documents each word stands. The vocabulary is all words of at least ``least_count`` toxic
documents whose share of these exceeds that of the clean ones by ``least_z`` standard errors. This is judged in Spark, for every
word, by the signed root of the likelihood ratio, which also holds for rare words and lopsided labels. ``most_words``,
the highest by that measure, is only a bound for the driver's memory. Every document is scored.

Defined cases: a null or empty text has severity by the cuts alone; repeated rows are each scored; labels with nulls
count nothing, and of several for an id the largest holds; with no toxic or no clean label every severity is 0 and
nothing is toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, texts, words_of

GRADES = 4
SLICE_BYTES = 2 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # by word, and at last of having any
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def above(self, found: list[bytes]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..., given the vocabulary words of a document with their repeats."""
        counts = Counter(found)
        x = sum(self.weights[self.words[w]] * np.log1p(n) for w, n in sorted(counts.items())) + (self.weights[-1] if found else 0)
        return _sigmoid(x - self.cuts)


@dataclass
class Sparse:
    """A matrix as its entries other than zero."""

    shape: tuple[int, int]
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    def by_row(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def by_col(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * u[self.row], self.shape[1])


def fit(x: Sparse, grade: np.ndarray, penalty: float = 2e-5, steps: int = 1500, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty, by gradient steps with momentum and scaling. Cuts stay ordered, as the
    first one and the logarithms of the gaps between them are the free parameters; weights stay at 0 or above."""
    n, k = x.shape
    cuts = grades - 1
    z = np.concatenate([np.zeros(k), [2.0], np.zeros(cuts - 1)])
    m, v = np.zeros_like(z), np.zeros_like(z)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, c = z[:k], np.cumsum(np.concatenate([z[k : k + 1], np.exp(z[k + 1 :])]))
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(c[None, :] - x.by_row(w)[:, None]), np.ones((n, 1))], axis=1)  # P(grade < g)
        slope = below * (1 - below)
        p = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        by_cut = np.zeros(cuts + 2)
        np.add.at(by_cut, grade + 1, up)
        np.add.at(by_cut, grade, -low)
        d_cut = -by_cut[1:-1] / n
        tail = np.cumsum(d_cut[::-1])[::-1]  # a cut moves with the first one and all gaps before it
        g = np.concatenate([x.by_col(up - low) / n + penalty * w, tail[:1], tail[1:] * np.exp(z[k + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        z[:k] = np.maximum(z[:k], 0)
    return z[:k], np.cumsum(np.concatenate([z[k : k + 1], np.exp(z[k + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, most_words: int = 1 << 16, least_count: int = 3, least_z: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit a model on at most ``fit_rows`` of the labelled documents (labels: doc_id, toxic)."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).alias("toxic"))
    sample = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows).withColumn("label_id", F.col("label_id").cast("string"))
    rows = docs.select(F.col(id_col).cast("string").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id").select("text", "toxic", "label_id")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                seen[toxic].update({*words_of(text)})
            words = [*(seen[False].keys() | seen[True].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([seen[t][w] for w in words], pa.int64()) for t in (True, False))], names=["word", "toxic", "clean"])

    counted = rows.mapInArrow(tally, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total_of = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total_of.get(True, 0), total_of.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()
    k, c = F.col("toxic"), F.col("clean")
    # How much likelier the word's documents are with their own shares of toxic and clean ones than with those of all.
    ratio = k * F.log(k / ((k + c) * (n_toxic / (n_toxic + n_clean)))) + F.when(c > 0, c * F.log(c / ((k + c) * (n_clean / (n_toxic + n_clean))))).otherwise(0.0)
    judged = counted.where((k >= least_count) & (k * n_clean > c * n_toxic)).select("word", F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z"))
    found = judged.where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(most_words).collect()
    words = {bytes(r["word"]): j for j, r in enumerate(found)}
    if not words:
        return Model()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            out = []
            for text in texts(batch.column(0)):
                hits = Counter(words[w] for w in words_of(text) if w in words)
                out.append((sorted(hits), [hits[j] for j in sorted(hits)]))
            at, hits = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.int32()))], names=["id", "toxic", "at", "hits"])

    # A row of a few numbers for each of at most fit_rows ids; of several texts with an id, one counts.
    found = rows.mapInArrow(features, "id string, toxic boolean, at array<int>, hits array<int>").groupBy("id").agg(F.max(F.struct("toxic", "at", "hits")).alias("r"))
    got = sorted((r["toxic"], r["at"], r["hits"]) for r in found.select("r.*").collect())
    hits = [np.array(h, float) for *_, h in got]
    total = np.array([h.sum() for h in hits])
    some, last = np.flatnonzero(total), len(words)
    row = np.concatenate([np.repeat(np.arange(len(got)), [len(h) for h in hits]), some])
    col = np.concatenate([*(np.array(a, int) for _, a, _ in got), np.full(len(some), last)])
    x = Sparse((len(got), last + 1), row, col, np.concatenate([*map(np.log1p, hits), np.ones(len(some))]))
    toxic = np.array([r[0] for r in got], bool)
    unseen = held_out_scores(x, toxic)
    some = unseen[toxic & (total > 0)]
    steps = np.quantile(some, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(some) else np.zeros(GRADES - 2)
    grade = np.where(toxic, 1 + np.searchsorted(steps, unseen, "left"), 0)
    weights, cuts = fit(x, grade)
    return Model(words, weights, cuts)


def held_out_scores(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """w.x - cut of each row by a two-grade model of the other half of the rows (every second one)."""
    half, out = np.arange(x.shape[0]) % 2, np.zeros(x.shape[0])
    for k in (0, 1):
        own = half[x.row] != k
        rows = np.flatnonzero(half != k)
        part = Sparse((len(rows), x.shape[1]), x.row[own] // 2, x.col[own], x.value[own])
        w, cut = fit(part, toxic[rows].astype(int), steps=400, grades=2)
        out[half == k] = x.by_row(w)[half == k] - cut[0]
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)), ``grade`` and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, none = shared.value, {}
        for batch in in_slices(batches, "text", SLICE_BYTES):
            out = []
            for text in texts(batch.column(1)):
                found = [w for w in words_of(text) if w in m.words]
                above = m.above(found) if found else none.setdefault(0, m.above([]))
                out.append((float(above.sum()), float(above[0]), int((above >= 0.5).sum()), bool(above[0] >= 0.5)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.float64(), pa.float64(), pa.int32(), pa.bool_())))], names=["id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in in_slices(batches, text_col, SLICE_BYTES):
            toxic = [bool(m.above([w for w in words_of(t or "") if w in m.words])[0] >= 0.5) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array([not t for t in toxic], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
