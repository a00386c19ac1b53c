"""Quality rules: counted base rules, and a log-likelihood ratio of hashed byte n-grams.

Two multinomials over hashed byte n-grams are counted, one over the trusted documents and one over the raw corpus (all
documents). A document's score is the sum of log(p_trusted / p_raw) over its n-grams, divided by their number. The
weights are integers (millionths), so the sum and its comparison with the threshold are exact and the same in any
order. What is gathered are two arrays of ``BUCKETS`` counts, whatever the size of the corpus. Trusted documents are told by a
join on 64-bit hashes of their ids, in one way at every size: Spark shuffles the texts once, and looks them up in the ids of their partition, without a sort.

Defined cases: a null or empty text has no words and no n-grams, score 0, and fails the base rules; a very long one is
held by one task, about ten times its bytes; repeated rows are each judged; a label without a document or without an id counts nothing; with no trusted document at all every weight is 0,
so the base rules alone decide; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, texts

ORDER, BUCKETS, SCALE = 3, 1 << 16, 1_000_000
#: Keep a document from this mean log-likelihood ratio on, in nats an n-gram.
THRESHOLD = -0.5
SYMBOLS, SPACE = b"#*$%&|<>", b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 8 << 20


def ngram_buckets(data: bytes, order: int = ORDER) -> np.ndarray:
    """The bucket of each byte n-gram that starts in ``data``."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(x) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = x[:n].copy()
    for i in range(1, order):
        h = h * np.uint32(257) + x[i : n + i]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def ngram_counts(docs: DataFrame, group_col: str) -> dict[bool, np.ndarray]:
    """Counts over all texts: {True: of rows whose ``group_col`` holds, False: of the others}.

    Each task sends one sparse row for each group and bucket it has seen; Spark adds them up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in in_slices(batches, "text", SLICE_BYTES):
            parts: dict[bool, list[np.ndarray]] = {False: [], True: []}
            for text, group in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                if text:
                    parts[bool(group)].append(ngram_buckets(text.encode("utf-8", "surrogatepass")))
            for group, found in parts.items():
                if found:
                    total[int(group)] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        for group in (0, 1):
            seen = np.flatnonzero(total[group])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), bool(group))), pa.array(seen.astype(np.int32)), pa.array(total[group][seen])], names=["grp", "bucket", "n"])

    rows = docs.select(F.col("text"), F.col(group_col).alias("grp")).mapInArrow(count, "grp boolean, bucket int, n long")
    out = {g: np.zeros(BUCKETS, np.int64) for g in (False, True)}
    for r in rows.groupBy("grp", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 * BUCKETS rows
        out[r["grp"]][r["bucket"]] = r["n"]
    return out


def weights(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket, in whole millionths of a nat.

    Raw counts are smoothed by one and trusted counts by as much of one as the trusted n-grams are of the raw ones, so that a
    bucket as frequent in both has exactly 0, however small the samples are.
    """
    if not trusted.sum():
        return np.zeros(len(raw), np.int64)
    share = trusted.sum() / raw.sum()
    return np.rint(np.log((trusted + share) / (share * (raw + 1))) * SCALE).astype(np.int64)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on exactly the six ASCII space characters
    spaces = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    repeated, n = 0, len(words)
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        often = Counter(grams)
        hit = np.zeros(n, bool)
        at = np.fromiter((often[g] > 1 for g in grams), bool, len(grams))
        for i in range(3):
            hit[i : i + len(grams)] |= at
        repeated = int(hit.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, trusted) of every document; trusted are those that ``labels`` (doc_id, quality) gives quality 1.

    Ids of any type are matched by the hash of their text.
    """

    def key(column: str) -> Column:
        return F.xxhash64(F.col(column).cast("string"))

    trusted = labels.where("quality = 1 and doc_id is not null").select(key("doc_id").alias("trusted_key")).distinct()
    rows = docs.select(key(id_col).alias("key"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("nameless"))
    named = rows.where("not nameless").join(trusted.hint("shuffle_hash"), F.col("key") == F.col("trusted_key"), "left").select("text", F.col("trusted_key").isNotNull().alias("trusted"))
    return named.unionByName(rows.where("nameless").select("text", F.lit(False).alias("trusted")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its base counts, ``base_failed``, ``score`` (nats an n-gram) and ``kept``.

    ``labels`` (doc_id, quality) names the trusted documents: those with quality 1. The trusted multinomial counts all of
    them, the raw multinomial every document.
    """
    counts = ngram_counts(marked(docs, labels, id_col, text_col), "trusted")
    table = docs.sparkSession.sparkContext.broadcast(weights(counts[True], counts[False] + counts[True]))
    least = round(threshold * SCALE)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for batch in in_slices(batches, "text", SLICE_BYTES):
            out: list[tuple] = []
            for text in texts(batch.column(1)):
                n, chars, symbols, lines, repeated = base_counts(text)
                buckets = ngram_buckets(text.encode("utf-8", "surrogatepass"))
                total, grams = int(w[buckets].sum()), len(buckets)
                failed = n < 50 or 100 * repeated > 50 * n
                out.append((n, chars, symbols, lines, repeated, failed, not failed and total >= least * grams, total / SCALE / max(grams, 1)))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(score, f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
        .withColumnRenamed("id", id_col)
    )
