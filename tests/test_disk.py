"""What is stored and shuffled is no more than what is needed, and is let go."""

import glob
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake.operators import setjoin
from strandlake.plans import queries
from strandlake.scratch import written


def test_shuffle_files_of_a_stored_table_are_let_go(spark):
    files = lambda: {*glob.glob("/tmp/blockmgr-*/*/shuffle_*.data")}
    before = files()
    table = written(spark.range(0, 100_000).repartition(7, F.col("id")), "dealt")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("j", [0.2, 0.5, 1.0])
def test_sets_that_share_too_little_are_told(spark, j):
    rng = random.Random(int(j * 10))
    sets = {i: {rng.getrandbits(63) if rng.random() < 0.6 else rng.randrange(300) for _ in range(rng.randrange(1, 25))} for i in range(150)}
    sets |= {1000 + i: {*sorted(sets[i])[rng.randrange(3) :]} or sets[i] for i in range(30)}
    rows = spark.createDataFrame([(i, [*s]) for i, s in sets.items()], "id long, items array<long>")
    told = {r["id"]: r["may"] for r in setjoin.sharing(rows, j).collect()}
    alike = {x for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= j * len(sets[a] | sets[b]) for x in (a, b)}
    assert {*told} == {*sets} and alike <= {i for i, may in told.items() if may} < {*sets}


def test_only_documents_that_share_are_stored(spark, tmp_path):
    base = [f"w{i}" for i in range(40)]
    texts = {1: base, 2: [*base[:36], "x"], 3: base, 4: [f"z{i}" for i in range(50)], 5: ["a", "b"], 6: [f"y{i}" for i in range(5)], 7: base[:20]}
    rows = [(i, " ".join(w), len(" ".join(w)) + (i == 3)) for i, w in texts.items()]
    spark.createDataFrame([*rows, (8, None, 0)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    known = queries._sharing_documents(spark, str(tmp_path))
    assert {(r["doc_id"], r["may"]) for r in known.collect()} == {(1, True), (2, True), (3, True), (4, False), (6, False), (7, True)}
    assert {r["id"] for r in queries._document_sets(spark, str(tmp_path), known.where("may")).collect()} == {1, 2, 7}
    got = {r["member"]: r["representative"] for r in queries.cluster_representatives(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 6: 6, 7: 7}
    assert {(r["a"], r["b"], r["common"]) for r in queries.cluster_candidates(spark, str(tmp_path)).collect()} == {(1, 2, 34), (2, 7, 18)}


def test_whole_sets_go_to_tiles_and_not_to_pairs(spark):
    """Forty sets that are all alike are 780 pairs, which used to hold a whole set each."""
    rows = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("item")).where("item <> 10 + id % 3")
    pairs = setjoin.similar_pairs(rows, 0.5)
    got = {(r["a"], r["b"]): r["common"] for r in pairs.collect()}
    assert got == {(a, b): 30 if a % 3 == b % 3 else 29 for a, b in itertools.combinations(range(40), 2)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "FlatMapCoGroupsInArrow" in plan
