"""Alignments, contigs, genomes and genes made from the ``lineitem`` and ``part`` tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("int").alias("tid"), F.concat_ws("~", "p_brand", F.col("p_partkey").cast("string")).alias("contig"), (500 + F.col("p_size") * 20).cast("bigint").alias("length"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs whose key leaves 9 when divided by 10 have no genome."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 9")
    return part.select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("genome_idx"), F.col("p_brand").alias("genome"), F.concat_ws("~", "p_brand", F.col("p_partkey").cast("string")).alias("contig"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two genes a contig; the second ends beyond the contig and is clamped."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint")
    two = F.array(
        F.struct(F.lit("a").alias("k"), (10 + size).alias("start"), (10 + size + 200).alias("end"), (2 * key).alias("line_no")),
        F.struct(F.lit("b").alias("k"), (150 + 3 * size).alias("start"), (5000 + size).alias("end"), (2 * key + 1).alias("line_no")),
    )
    rows = part.select(F.concat_ws("~", "p_brand", key.cast("string")).alias("contig"), key.alias("key"), F.inline(two))
    return rows.select(F.concat(F.lit("g"), F.col("key").cast("string"), "k").alias("gene_id"), "contig", F.lit("CDS").alias("feature"), "start", "end", "line_no")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Joined by the number of the contig, as records and contigs are later.
    tid = F.col("l_partkey").cast("int").alias("tid")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(tid, "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("tid"), (500 + F.col("p_size") * 20).cast("bigint").alias("len"))
    rows = line.join(sizes, "tid").select(
        "*", F.col("l_quantity").cast("bigint").alias("n1"), (F.col("l_quantity").cast("bigint") + 10).alias("n2"), (F.round(F.col("l_discount") * 100).cast("bigint") % 3).alias("nd"), F.round(F.col("l_tax") * 100).cast("bigint").alias("mm")
    )
    n1, n2, nd, sup = F.col("n1"), F.col("n2"), F.col("nd"), F.col("l_suppkey")
    rn = F.row_number().over(Window.partitionBy("l_returnflag", "tid").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    kind = F.when(F.col("l_linenumber") == 7, 2048).when(F.col("l_linenumber") == 6, 256).otherwise(0)
    flag = kind + F.when(F.col("l_linestatus") == "F", 3).otherwise(1) + F.when(sup % 37 == 0, 4).otherwise(0)
    return rows.select(
        F.col("l_returnflag").alias("sample"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("sample_idx"),
        F.concat_ws("_", F.lit("r"), F.col("tid").cast("string"), F.floor((rn - 1) / 2).cast("string")).alias("qname"), flag.cast("int").alias("flag"),
        "tid", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + sup * 31) % (F.col("len") - (n1 + n2 + nd))).cast("bigint").alias("pos"),
        F.when(sup % 61 == 60, 255).otherwise(sup % 61).cast("int").alias("mapq"), F.concat(n1.cast("string"), F.lit("M"), F.when(nd > 0, F.concat(nd.cast("string"), F.lit("D"))).otherwise(""), n2.cast("string"), F.lit("M")).alias("cigar"),
        F.col("tid").alias("mtid"), F.lit(0).cast("bigint").alias("mpos"), F.lit(0).cast("bigint").alias("tlen"), (n1 + n2 + F.col("l_linenumber")).cast("int").alias("seq_len"),
        (F.col("mm") + nd).alias("nm"), (n1 + n2 - F.col("mm") - nd).alias("align_score"), (F.col("l_orderkey") % 2).cast("int").alias("shard"),
    )
