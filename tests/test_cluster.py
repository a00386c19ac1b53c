"""Similar sets, representatives of large and awkward graphs, and identity by fragments."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import cluster, components, fragments, setjoin


@pytest.mark.parametrize("j", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_by_all_pairs(spark, monkeypatch, j):
    monkeypatch.setattr(setjoin, "TILE", 7)
    rng = random.Random(int(j * 10))
    sets = {f"s{i:03}": {rng.randrange(60) for _ in range(rng.randrange(1, 25))} for i in range(120)}
    for i in range(40):  # near copies
        base = sorted(sets[f"s{i:03}"])
        sets[f"t{i:03}"] = {*base[: max(1, len(base) - rng.randrange(3))], *([1000 + i] if i % 3 else [])}
    sets = {k: v | {7} for k, v in sets.items()}  # an item of all
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= j * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "id string, item long")
    assert {(r["a"], r["b"]): r["common"] for r in setjoin.similar_pairs(rows, j).collect()} == want
    assert setjoin.similar_pairs(rows.limit(0), j).collect() == []


def test_an_item_of_all_sets_makes_no_pairs(spark):
    own = spark.range(0, 10_000).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.col("id") * 20 + k))).alias("item"))
    assert setjoin.prefixes(own, 0.2).count() == 0


def in_order(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[max(a, b)].add(min(a, b))
    chosen = set()
    for i in range(n):
        if not near[i] & chosen:
            chosen.add(i)
    return chosen


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_chosen_nodes_are_those_of_a_pass_in_order(spark, most):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(500)}
    df = spark.createDataFrame([(b, a) for a, b in edges], "rank long, better long")
    got = {r["rank"] for r in cluster.chosen_ranks(df, most).where("chosen").collect()}
    assert got == in_order(400, edges) - ({*range(400)} - {x for e in edges for x in e})


def test_a_chain(spark):
    """Ten thousand nodes, each close to the one before it."""
    chain = spark.range(1, 10_000).select(F.col("id").alias("rank"), (F.col("id") - 1).alias("better"))
    got = [r["rank"] for r in cluster.chosen_ranks(chain).where("chosen").orderBy("rank").collect()]
    assert got == [*range(0, 10_000, 2)]


def test_components(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200) if i % 50 != 49], "a string, b string")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {f"{i:03}": f"{i // 50 * 50:03}" for i in range(200)}


def changed(rng, seq, rate):
    return "".join(rng.choice("ACGT".replace(c, "")) if rng.random() < rate else c for c in seq)


@pytest.fixture(scope="module")
def genomes():
    """a; b has a's first half with few changes and other bases for the rest; c is all of a with few changes, turned round; d is small."""
    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(40_000))
    other = "".join(rng.choice("ACGT") for _ in range(20_000))
    turned = changed(rng, a, 0.02).translate(str.maketrans("ACGT", "TGCA"))[::-1]
    small = a[:300]
    return {"a": a, "b": changed(rng, a[:20_000], 0.02) + other, "c": turned, "d": small, "e": changed(rng, small, 0.005)}


def test_fragments(spark, genomes):
    rows = spark.createDataFrame([(g, "x", s) for g, s in genomes.items()], "genome string, contig string, seq string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e")], "a string, b string")
    got = {(r["a"], r["b"]): (r["ani"], r["share"]) for r in fragments.identities(pairs, fragments.fragment_hashes(rows)).collect()}
    assert abs(got["a", "b"][0] - 0.98) < 0.006 and 0.4 < got["a", "b"][1] < 0.65
    assert abs(got["a", "c"][0] - 0.98) < 0.006 and got["a", "c"][1] == 1.0
    assert got["d", "e"] == (None, None)


def test_aligned_fraction_changes_clusters(spark, tmp_path, genomes):
    paths = []
    for g in "abc":
        paths.append(str(tmp_path / f"{g}.fna"))
        (tmp_path / f"{g}.fna").write_text(f">x\n{genomes[g]}\n")
    out = tmp_path / "out.tsv"

    def run(*more):
        cli.main(["cluster", "-f", *paths, "-o", str(out), "--ani", "95", "--prethreshold-ani", "90", *more], spark)
        return {tuple(x.split("\t")) for x in out.read_text().splitlines()[1:]}

    assert run() == {("a", "a"), ("a", "b"), ("a", "c")}
    assert run("--min-aligned-fraction", "80") == {("a", "a"), ("a", "c"), ("b", "b")}
    assert run("--min-aligned-fraction", "80", "--fragment-length", "20000") == {("a", "a"), ("a", "c"), ("b", "b")}


def test_items_of_sets_are_shuffled_once(spark):
    """Sizes that are given are not counted again, and items are not dealt out by themselves more than once."""
    items = spark.range(0, 1000).selectExpr("id % 50 as id", "20L as n", "id as item")
    plan = setjoin.prefixes(items, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_shingles_of_a_very_long_text(spark, tmp_path):
    """Time that grows with the square of a text's words would be minutes here."""
    from strandlake.plans import queries

    text = " ".join(f"W{i % 90_001}" for i in range(100_000))
    spark.createDataFrame([(1, text, len(text)), (2, text.lower(), 3), (3, "a b", 3), (4, "a b c", 5), (5, None, 0)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r["id"]: (r["n"], r["size"]) for r in queries._document_sets(spark, str(tmp_path)).select("id", F.size("items").alias("n"), "size").collect()}
    assert got == {1: (90_001, len(text)), 4: (1, 5)} and time.time() - began < 60
