"""Whole records in sorted BAM files, tags, and the check of order."""

import struct

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import order
from strandlake.sources import binary, text

HEADER = "@HD\tVN:1.5\tSO:unsorted\n@SQ\tSN:c1\tLN:5000\n@SQ\tSN:c2\tLN:900\n@RG\tID:g1\n@PG\tID:made\n"


@pytest.fixture
def path(tmp_path):
    lines = []
    for k in range(300):
        contig, pos = ("c1", "c2")[k % 2], 1 + (k * 37) % 700
        seq, qual = ("ACGTN" * 20)[: 90 + k % 5], "".join(chr(33 + (k + i) % 60) for i in range(90 + k % 5))
        flag, place = (4, ("*", "0", "0", "*")) if k % 50 == 0 else (16 * (k % 2), (contig, str(pos), "60", f"{len(seq)}M"))
        tags = ["NM:i:%d" % (k % 7), "AS:i:-5", "RG:Z:g1", f"XF:f:{k / 4:g}", "XA:A:q", "XH:H:1AE3", "XB:B:s,1,-2,300", "XU:i:4000000000"]
        lines.append("\t".join([f"r{k}", str(flag), *place, "*", "0", "0", seq, qual, *tags]))
    (tmp_path / "in.sam").write_text(HEADER + "\n".join(lines) + "\n")
    return str(tmp_path / "in.sam"), {x.split("\t")[0]: x.split("\t") for x in lines}


def bases(raw):
    """(bases, qualities) of a record."""
    _, _, l_name, _, _, n_cigar, _, n = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + l_name + 4 * n_cigar
    packed = raw[at : at + (n + 1) // 2]
    return "".join("=ACMGRSVTWYHKDBN"[x] for b in packed for x in (b >> 4, b & 15))[:n], "".join(chr(33 + q) for q in raw[at + (n + 1) // 2 : at + (n + 1) // 2 + n])


def read(spark, path):
    binary.register(spark)
    return spark.read.format("bam").option("more", "raw,tags,place").option("split_bytes", 2_000).load(path)


@pytest.fixture
def several_parts(spark):
    """Small tables are not put into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filter_writes_whole_sorted_records(spark, path, tmp_path, several_parts):
    sam, lines = path
    one, two, bam = (str(tmp_path / x) for x in ("one.bam", "two.bam", "first.bam"))
    cli.main(["filter", "-b", sam, "-o", bam, "--min-read-aligned-length", "92"], spark)
    kept = {k: f for k, f in lines.items() if f[1] != "4" and int(f[5][:-1]) >= 92}
    rows = {r["qname"]: r for r in read(spark, bam).collect()}
    assert {*rows} == {*kept}
    for name, f in kept.items():
        assert bases(rows[name]["raw"]) == (f[9], f[10])
        want = {t[:2]: t[5:] for t in f[11:]}
        assert rows[name]["tags"] == want | {"XF": f"{float(want['XF']):g}"}
    # Two inputs to two outputs; records are the same bytes.
    cli.main(["filter", "-b", bam, sam, "-o", one, two, "--min-read-aligned-length", "94"], spark)
    again = {r["qname"]: bytes(r["raw"]) for r in read(spark, one).collect()}
    assert again == {k: bytes(rows[k]["raw"]) for k, f in kept.items() if int(f[5][:-1]) >= 94}
    assert {r["qname"] for r in read(spark, two).collect()} == {*again}
    placed = [(r["tid"], r["pos"]) for r in read(spark, one).orderBy("file", "block", "at").collect()]
    assert placed == sorted(placed) and len({r["file"] for r in read(spark, one).select("file").collect()}) > 1
    head = binary.header_of(one)
    assert b"SO:coordinate" in head and head.count(b"@HD") == 1 and binary.header_of(bam).count(b"@SQ") == 2
    with pytest.raises(ValueError):
        cli.main(["filter", "-b", bam, sam, "-o", one + ".x.bam"], spark)


def test_unmapped_records_come_last(spark, path, tmp_path):
    out = str(tmp_path / "inverse.bam")
    cli.main(["filter", "-b", path[0], "-o", out, "--min-read-aligned-length", "94", "--inverse"], spark)
    tids = [r["tid"] for r in read(spark, out).orderBy("file", "block", "at").collect()]
    assert tids.count(None) == 6 and None not in tids[: len(tids) - 6]


def test_tags_of_sam(spark, path):
    rows = text.sam(spark, path[0], more=["tags"]).collect()
    assert all(r["tags"] == {t[:2]: t[5:] for t in path[1][r["qname"]][11:]} for r in rows) and len(rows) == 300
    assert "tags" not in text.sam(spark, path[0]).columns


def test_check_sorted(spark, path, tmp_path):
    bam = str(tmp_path / "in.bam")
    rows, headers = text.sam_and_headers(spark, [path[0]], ["line"])
    binary.write_bam(rows, headers.contigs, bam)
    args = ["contig", "-o", str(tmp_path / "out.tsv"), "--check-sorted", "-b"]
    with pytest.raises(ValueError, match="appears to be unsorted"):
        cli.main([*args, path[0]], spark)
    assert cli.main([*args, bam], spark) == 0


@pytest.mark.parametrize("tids,bad", [([[0, 0, 1], [1, 2], [2]], False), ([[0, 1, 0], [2]], True), ([[0, 2], [1, 3]], True), ([[3], []], False), ([[1], [0]], True)])
def test_order_over_splits(spark, tids, bad):
    rows = [("s", f"part-{f}", 0, k, t) for f, part in enumerate(tids) for k, t in enumerate(part)]
    df = spark.createDataFrame(rows, "sample string, file string, block long, at long, tid int").repartition(3, F.col("at"))
    assert (order.unsorted_samples(df).count() == 1) == bad
