"""Periodic runs against a walk over all periods."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import queries, runs


def brute(words, min_length=6, min_exponent=4):
    """Every stretch of words that come again q words later, for every q; of equal stretches the smallest q."""
    n, out = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    k = rng.randrange(1, 6)
    words = [str(rng.randrange(k)) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        p = [str(rng.randrange(k + 2)) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (p * rng.randrange(2, 9))[: rng.randrange(1, 120)]
    return [w.encode() for w in words]


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("least,exponent", [(6, 4), (9, 5), (5, 4)])
def test_runs_by_brute_force(monkeypatch, few, least, exponent):
    monkeypatch.setattr(runs, "FEW", few)
    rng = random.Random(few + least)
    for _ in range(400):
        words = made(rng)
        assert runs.runs(words, least, exponent) == brute(words, least, exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=6), st.integers(1, 9))
def test_runs_of_two_words(lead, period, times):
    words = lead + period * times + lead[::-1]
    assert runs.runs(words) == brute(words)


def test_least_overlap():
    assert runs.least_overlap() == 5 and runs.least_overlap(20, 4) == 15 and runs.least_overlap(5, 4) == 4


def test_most_documents_are_masked():
    words = [str(i).encode() for i in range(1000)]
    assert runs.surviving(runs.numbered(words), 5, 6) == []
    assert runs.surviving(runs.numbered(words + [b"x"] * 7 + words[:9]), 5, 6) == [(0, 9), (1000, 1016)]


@pytest.mark.parametrize("words", [[b"x"] * 200_000, [b"x", b"y"] * 100_000, [b"%d" % (i % 2500) for i in range(200_000)]], ids=["one", "two", "long"])
def test_very_long_texts(words):
    p = len({*words})
    assert runs.runs(words) == [(0, len(words), p)]


def test_find_runs(spark):
    rows = [(1, "go " * 6 + "on"), (1, "go " * 6 + "on"), (2, None), (3, ""), (None, "a b " * 5), (4, "so so so so so"), (5, "é　é   " * 8), (6, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, id string, runs int")
    got = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()}
    assert got[1, 7] == ([(0, 6, 1)], "go on") and got[2, 0] == ([], "") and got[3, 0] == ([], "") and got[None, 10] == ([(0, 10, 2)], "a b")
    assert got[4, 5] == ([], "so so so so so") and got[5, 16] == ([(0, 16, 2)], "é　é  ") and got[6, 100_000] == ([(0, 100_000, 1)], "x")
    assert runs.find_runs(docs).count() == 8 and runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_exponent=2)


def test_periods_of_the_contract(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "  ".join(str(rng.randrange(30)) for _ in range(rng.randrange(90)))) for i in range(300)] + [(None, "a b c"), (7777, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), (r["text"] or "").split()) for r in queries._with_periods(docs).collect())
    want = []
    for i, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        want.append((str(i), w))
    assert got == sorted(want)
