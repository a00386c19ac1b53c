"""Language-model scores from a weighted backoff automaton over n-grams (trigrams by default).

The model smooths each order with the one below: P_k(w | h) = (c(h w) + T_k * P_{k-1}(w | h')) / (c(h) + T_k), where h' is h
without its first word, and P_1(w) = (c(w) + 1) / (N + V + 1). T_k is fitted on the training counts: it makes the weight that
contexts pass on to the order below, over all training tokens, equal to the share of tokens that are n-grams seen once.

As an automaton (``Automaton``): every n-gram of fewer than ``order`` words that training has is a state, and so are the start
of a text and the root. Its arcs are the n-grams seen after it; one leads to the longest state that ends with its words. Its failure
arc has the weight log10(T / (c(h) + T)) and leads to the state of h'. The root has an arc for every word. A text is read
once from left to right, carrying the state and adding up weights. All texts of a chunk step together, long ones in stretches:
one that begins ``order`` - 1 tokens early is in the right state when its own part begins.

The automaton grows with the corpus and is never gathered in one place. Texts are cut into chunks of documents; each chunk
sends the fingerprints of its n-grams with their training counts, by ranges of the hash; each range adds up counts and
sends every chunk the totals of just those n-grams that the chunk's texts can take. There are so many ranges that one holds
about ``GROUP_KEYS`` n-grams, whatever the corpus and the settings are; so fingerprints of 40 bits within a range keep
apart all but a few n-grams in a million at every size. A frequent n-gram is one entry a chunk.

Defined cases: a null or empty text is only the end token; ids are taken as text for the split (a null id as ""); repeated
rows each train and are each scored; a very long text is a chunk of its own; columns besides id and text are ignored; with
no training text at all every probability is that of an unseen word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored, texts

ORDER = 3
CHUNK_BYTES = 5 << 20
GROUP_KEYS = 2 << 20
#: Tokens of a stretch of a long text.
STRETCH = 512
#: Counts are tallied by their logarithm, this many classes a doubling.
CLASSES, DOUBLINGS = 8, 56
_END, _START, _MASK = np.uint64(0x5851F42D4C957F2D), 0x14057B7EF767814F, (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF, _ROW = np.uint64(32), 6


def is_held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text and of the end token."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = _END
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _ODD
    return x ^ (x >> np.uint64(29))


class Chunk:
    """Some documents as numbers: for each order the distinct n-grams by their hash, and where each one stands."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, order: int = ORDER):
        self.lengths, self.order = lengths, order
        self.starts = np.cumsum(lengths) - lengths
        self.keys: list[np.ndarray] = []  # ascending hashes
        self.first: list[np.ndarray] = []  # a token at which the n-gram ends
        self.at: list[np.ndarray] = []  # for each token the number of the n-gram that ends with it
        gram = np.zeros(len(tokens), np.uint64)
        for k in range(order):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.starts] = np.uint64(_START * k & _MASK)
            gram = _mixed(before * _ODD + tokens + np.uint64(k))
            keys, first, at = np.unique(gram, return_index=True, return_inverse=True)
            self.keys.append(keys), self.first.append(first), self.at.append(at.astype(np.int32))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Training counts of the n-grams of each order. ``train`` says it of each document."""
        of_token = np.repeat(train, self.lengths)
        return [np.bincount(at[of_token], minlength=len(keys)) for keys, at in zip(self.keys, self.at)]

    def dealt(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of sending, range, fingerprint) of all n-grams, those of one order after those of another.

        A hash is a fraction of 1; times the number of ranges, its whole part is the range and the rest the fingerprint.
        """
        h, n = np.concatenate(self.keys), np.uint64(ranges)
        low = (h & np.uint64(0xFFFFFFFF)) * n
        high = (h >> _HALF) * n + (low >> _HALF)
        rest = ((high & np.uint64(0xFFFFFFFF)) << np.uint64(8)) | ((low & np.uint64(0xFFFFFFFF)) >> np.uint64(24))
        rest |= np.repeat(np.arange(self.order, dtype=np.uint64) << np.uint64(40), [len(k) for k in self.keys])
        bucket = (high >> _HALF).astype(np.int64)
        sent = np.argsort(bucket, kind="stable")
        return sent, bucket[sent], rest[sent]


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as all their lowest bytes, then all their second ones, and so on: what shuffles compress best."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _integers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _sent_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their gaps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), _ROW)


def _got_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_integers(data, _ROW), dtype=np.uint64)


def _sent_counts(n: np.ndarray) -> bytes:
    return zlib.compress(_planes(n, 8), 1)


def _got_counts(data: bytes) -> np.ndarray:
    return _integers(zlib.decompress(data), 8).astype(np.int64)


def tally(counts: np.ndarray) -> np.ndarray:
    """How many of the counts above 0 are in each class of their logarithm; the first class is the count 1."""
    return np.bincount(np.rint(CLASSES * np.log2(counts[counts > 0])).astype(np.int64), minlength=CLASSES * DOUBLINGS)


def fitted(tallies: np.ndarray) -> list[float]:
    """T for each order above 1 from the tallies of all orders (a row each)."""
    c = 2.0 ** (np.arange(tallies.shape[1]) / CLASSES)
    out = []
    for contexts, own in zip(tallies, tallies[1:]):
        low, high = 2.0**-10, 2.0**30
        for _ in range(60):
            t = (low * high) ** 0.5
            low, high = (t, high) if (contexts * c * t / (c + t)).sum() < own[0] else (low, t)
        out.append(low)
    return out


class Automaton:
    """The part of the model that the texts of a chunk can reach.

    States: 0 is the root, j < order the start of a text as a context of j words, then come the n-grams of each order
    below the highest. An arc is an n-gram; at any token, the arc of order k is the n-gram of the last k tokens.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], n: int, v: int, n_texts: int, t: list[float]):
        order, sizes = chunk.order, [len(x) for x in counts]
        state_at = np.cumsum([order, *sizes[:-1]])  # the first state of each order
        self.arc_at = np.cumsum([0, *sizes[:-1]])
        total = int(state_at[-1])
        self.start = order - 1
        self.level = np.zeros(total, np.int8)
        self.fail = np.zeros(total, np.int32)
        self.fail_weight = np.zeros(total)
        self.level[:order] = np.arange(order)
        self.fail[1:order] = np.arange(order - 1)
        for j in range(1, order):
            self.fail_weight[j] = np.log10(t[j - 1] / (n_texts + t[j - 1]))
        weight, target = [], []
        p = (counts[0] + 1) / (n + v + 1)
        self.root_weight = np.log10(p)
        longest = np.zeros(0, np.int32)
        for k in range(order):
            first, seen = chunk.first[k], counts[k] > 0
            if k:
                begins = np.isin(first, chunk.starts)
                context = np.where(begins, n_texts, counts[k - 1][chunk.at[k - 1][first - 1]])
                suffix = chunk.at[k - 1][first]
                p = (counts[k] + t[k - 1] * p[suffix]) / (context + t[k - 1])
            if k < order - 1:
                own = slice(state_at[k], state_at[k] + sizes[k])
                shorter = longest[suffix] if k else np.zeros(sizes[0], np.int32)
                self.level[own], self.fail[own] = k + 1, shorter
                self.fail_weight[own] = np.log10(t[k] / (counts[k] + t[k]))
                longest = np.where(seen, np.arange(own.start, own.stop, dtype=np.int32), shorter)
                target.append(longest)
            else:
                target.append(longest[suffix] if k else np.zeros(sizes[0], np.int32))
            weight.append(np.where(seen, np.log10(p), np.nan) if k else self.root_weight)
        self.weight, self.target = np.concatenate(weight), np.concatenate(target)  # of arcs; a weight is NaN where there is none
        self.at = [at + offset for at, offset in zip(chunk.at, self.arc_at)]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, weights) after reading a token in each state: an arc if there is one, else a failure arc and again."""
        weight = np.zeros(len(state))
        arc = np.empty(len(state), np.int64)
        for k in range(len(self.at) - 1, -1, -1):
            here = self.level[state] == k
            arc[here] = self.at[k][token[here]]
            lost = here.copy()
            lost[here] = np.isnan(self.weight[arc[here]])
            if lost.any():
                weight[lost] += self.fail_weight[state[lost]]
                state = np.where(lost, self.fail[state], state)
        return self.target[arc], weight + self.weight[arc]

    def read(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of each text."""
        parts = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        early = np.where(nth > 0, len(self.at) - 1, 0)
        begin = starts[text] + nth * STRETCH - early
        size = np.minimum(starts[text] + lengths[text], begin + early + STRETCH) - begin
        longest_first = np.argsort(-size, kind="stable")
        text, begin, size, early = (x[longest_first] for x in (text, begin, size, early))
        state = np.where(early > 0, 0, self.start)
        total = np.zeros(len(text))
        for i in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -i, "left"))
            state[:m], weight = self.step(state[:m], begin[:m] + i)
            total[:m] += np.where(early[:m] > i, 0, weight)
        return np.bincount(text, total, len(lengths))


def chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """(chunk, ids, train, lengths, n_words, tokens, n_tokens, n_train, n_texts): a row per chunk of documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches, "text", CHUNK_BYTES):
            found = [token_hashes(t) for t in texts(batch.column(1))]
            train = np.array([not is_held_out(i, folds, fold) for i in batch.column(0).to_pylist()], bool)
            lengths = np.array([len(x) for x in found], np.int64)
            vocabulary, at = np.unique(np.concatenate(found), return_inverse=True)
            tokens = zlib.compress(vocabulary.tobytes() + at.astype("<u4").tobytes(), 1)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            row = {
                "chunk": pa.array([number]), "ids": ids, "train": pa.array([train.tobytes()], pa.binary()),
                "lengths": pa.array([lengths.tobytes()], pa.binary()), "n_words": pa.array([len(vocabulary)]),
                "tokens": pa.array([tokens], pa.binary()), "n_tokens": pa.array([int(lengths.sum())]),
                "n_train": pa.array([int(lengths[train].sum())]), "n_texts": pa.array([int(train.sum())]),
            }
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    schema = f"chunk long, ids array<{kind}>, train binary, lengths binary, n_words long, tokens binary, n_tokens long, n_train long, n_texts long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _opened(lengths: bytes, n_words: int, tokens: bytes, order: int) -> Chunk:
    data = zlib.decompress(tokens)
    vocabulary = np.frombuffer(data, np.uint64, n_words)
    return Chunk(np.frombuffer(lengths, np.int64), vocabulary[np.frombuffer(data, "<u4", offset=8 * n_words)], order)


def totals(parts: DataFrame, ranges: int, order: int) -> DataFrame:
    """(chunk, bucket, counts, tallies): training totals over all chunks, for each chunk in the order in which it sent its
    n-grams; one row of each range has the tallies of all its n-grams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = _opened(r["lengths"], r["n_words"], r["tokens"], order)
                sent, bucket, keys = c.dealt(ranges)
                n = np.concatenate(c.counts(np.frombuffer(r["train"], bool)))[sent]
                del c, sent
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = [*zip(begin, [*begin[1:], len(bucket)])]
                row = [pa.array(bucket[begin]), pa.array([r["chunk"]] * len(begin), pa.int64()), pa.array([_sent_keys(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([_sent_counts(n[a:b]) for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["bucket", "chunk", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        each = [_got_keys(x.as_buffer()) for x in t.column("keys")]
        uniq, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.concatenate([_got_counts(x.as_buffer()) for x in t.column("counts")]), minlength=len(uniq)).astype(np.int64)
        ends = np.cumsum([0, *map(len, each)])
        counts = [_sent_counts(total[at[a:b]]) for a, b in zip(ends, ends[1:])]
        tallies = np.concatenate([tally(total[(uniq >> np.uint64(40)) == k]) for k in range(order)])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "counts": pa.array(counts, pa.binary()), "tallies": pa.array([tallies.tolist()] + [None] * (len(each) - 1), pa.list_(pa.int64()))})

    sent = parts.select("chunk", "train", "lengths", "n_words", "tokens").mapInArrow(send, "bucket long, chunk long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, counts binary, tallies array<long>")


def score(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Each document with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the documents whose crc32 of the id as text, mod ``folds``, is not ``fold``.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    parts = stored(chunks(docs, id_col, text_col, folds, fold), "chunks")
    tokens, n, n_texts = (int(x or 0) for x in parts.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_texts")).first())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-order * tokens // GROUP_KEYS))
    added = stored(totals(parts, ranges, order), "totals")
    tallies = np.zeros(order * CLASSES * DOUBLINGS)
    for r in added.where("tallies is not null").select(F.posexplode("tallies")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        tallies[r["pos"]] = r["n"]
    tallies = tallies.reshape(order, -1)
    v, t = int(tallies[0].sum()), fitted(tallies)

    def read(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        r = chunk.drop_columns(["ids"]).to_pylist()[0]
        c = _opened(r["lengths"], r["n_words"], r["tokens"], order)
        replies = replies.sort_by("bucket")
        sent = c.dealt(ranges)[0]
        got = np.empty(len(sent), np.int64)
        got[sent] = np.concatenate([_got_counts(x.as_buffer()) for x in replies.column("counts")])
        counts = np.split(got, np.cumsum([len(k) for k in c.keys])[:-1])
        a = Automaton(c, counts, n, v, n_texts, t)
        known = np.add.reduceat(counts[0][c.at[0]] > 0, c.starts, dtype=np.int64)
        base = np.add.reduceat(a.root_weight[c.at[0]], c.starts)
        columns = {"id": chunk.column("ids").combine_chunks().flatten(), "held_out": ~np.frombuffer(r["train"], bool), "n_tokens": c.lengths, "n_known": known}
        columns |= {"train_tokens": np.full(len(known), n), "base_score": base, "score": a.read(c.starts, c.lengths)}
        return pa.table(columns)

    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    slim = parts.select("chunk", "ids", "train", "lengths", "n_words", "tokens")
    scored = slim.groupBy("chunk").cogroup(added.select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(read, schema)
    return scored.withColumnRenamed("id", id_col)
