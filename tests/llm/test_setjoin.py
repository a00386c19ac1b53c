"""The join of sets of shingles against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import neardup, setjoin
from strandlake.llm.neardup import shingles


def by_pairs(rows):
    """Components by comparing all pairs."""
    sets = [(i, {*shingles(t or "").tolist()}) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and (a == b or (x and y and 100 * len(x & y) >= 80 * len(x | y))):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {(i, len(s)): None if i is None else root(i) for i, s in sets}


def texts(rng):
    """Sets of all sizes around the border of 0.8, chains of edits, passages that many share, copies."""
    rows = []
    for size in [5, 6, 7, 8, 9, 10, 12, 14, 18, 24, 30, 40, 50, 60, 66, 70, 80, 90, 120, 200, 400]:
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(6):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(1, max(2, size // 40 + 2))):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(2))]
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(10, 80))) + " " + passage for _ in range(60)]
    rows += [rows[3]] * 3 + ["", "a", "a b", "a b c d", "a b c d e", "b c d e f", None]
    out = list(enumerate(rows))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("at", [5, 20, 64, None])
def test_links_are_those_of_all_pairs(spark, at):
    rows = texts(random.Random(11)) + [(None, "no id here at all"), (3, "another text of the third document, not like the first one")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, key int")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in setjoin.similar_sets(docs, at=at).collect()}
    assert got == by_pairs(rows)


def test_pairs_at_the_border(spark):
    """Of a base and variants with shared shares just at, above and below 0.8, exactly the right ones are linked."""
    rng, rows = random.Random(5), []
    for n in (*range(5, 40), 63, 64, 65, 66, 80, 81, 100, 333):
        base = [f"{n}b{k}" for k in range(n + 4)]  # n shingles
        for cut in range(0, n, max(1, n // 25)):
            rows.append(" ".join(base[cut:]))  # n - cut of the same
        rows.append(" ".join(base))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in setjoin.similar_sets(docs).collect()} == by_pairs(rows)


def test_windows_hold_what_linked_sets_share():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(4, 300)
        m = rng.randrange(setjoin.overlap(n), n * 100 // 80 + 1)
        common = -(-80 * (n + m) // 180)
        if common > min(n, m):
            continue
        shared, a, b = (rng.sample(range(1 << 30), k) for k in (common, n - common, m - common))
        x, y = sorted({*shared, *a})[: setjoin.window(n)], sorted({*shared, *b})[: setjoin.window(m)]
        assert len({*x} & {*y}) >= max(setjoin.shared_least(n), setjoin.shared_least(m))


def test_least_as_expression(spark):
    rows = spark.range(4, 400).select("id", setjoin._least(F.col("id")).alias("least")).collect()
    assert all(r["least"] == setjoin.shared_least(r["id"]) for r in rows)


def test_boundary_goes_by_cost():
    assert setjoin.boundary({n: 10 for n in range(5, 64)}, 1.0) < setjoin.boundary({n: 10 for n in range(5, 64)}, 6.0)


def test_hot_lists_make_no_pairs(spark):
    """A passage in all documents, a quarter of each: no set has enough shingles in common with others for a key."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) + " " + passage) for i in range(2000)]
    nodes = setjoin.sketch(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("id", "node")
    assert setjoin.buckets_of(nodes).count() == 0


def test_empty_and_wrong_ids(spark):
    assert setjoin.similar_sets(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    with pytest.raises(ValueError):
        setjoin.similar_sets(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_buckets_with_nearly_the_same_members_are_one_look(spark, monkeypatch):
    """Thirty lists of the same 64 sets, each without one or two of them: a pair is compared in few of them, and all possible links are found."""
    monkeypatch.setattr(neardup, "TILE", 8)
    made, tiles = [], neardup._tiles
    monkeypatch.setattr(neardup, "_tiles", lambda placed, by: made.append(neardup.stored(tiles(placed, by), "tiles")) or made[-1])
    cells = lambda i: bytes(100 if k in (i // 2, 100 + i) else 0 for k in range(setjoin.CELLS))
    nodes = spark.createDataFrame([(i, 200, cells(i)) for i in range(64)], "node long, n long, sign binary")
    members = {key: [i for i in range(64) if i not in (key, 2 * key % 64)] for key in range(1, 31)}
    buckets = spark.createDataFrame([(key, i, 0) for key, x in members.items() for i in x], "key long, node long, pivot long")
    near = lambda x, y, n_x, n_y: (x != y).sum(axis=1) <= 2  # noqa: E731  # the same first cell
    rule = neardup.Rule(80, setjoin.LINKED.sign, near)
    comps = spark.createDataFrame([], "node long, component long")
    got = {(r["a"], r["b"]) for r in neardup._open_edges(buckets, nodes, comps, rule).collect()}
    assert got == {(i, i + 1) for i in range(0, 64, 2)}
    assert made[0].count() < sum(len(x) for x in members.values()) * 8 / 3
