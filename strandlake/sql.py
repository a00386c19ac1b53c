"""Tables and functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="s: bigint, e: bigint")
class CigarBlocks:
    """``SELECT * FROM cigar_blocks(cigar, pos)``, also with LATERAL; ``functions.cigar.blocks`` is the fast form."""

    def eval(self, cigar: str, pos: int) -> Iterator[tuple[int, int]]:
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
            if op in "M=X":
                yield pos, pos + int(n)
            if op in "M=XDN":
                pos += int(n)


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Make tables visible as views of their names, and register the table functions."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark.udtf.register("cigar_blocks", CigarBlocks)
