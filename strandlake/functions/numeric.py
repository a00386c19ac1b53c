"""Arithmetic in single precision where results must equal those of 32-bit code, and the text of such numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, exact: bool = False) -> Column:
    """a / b, 0 where b is 0. ``exact``: both are rounded to 32 bits first and the quotient once; the quotient of two such numbers
    in 64 bits, rounded once, is the same as one computed in 32 bits."""
    if exact:
        a, b = a.cast("float"), b.cast("float")
        return F.when(b == 0, F.lit(0.0).cast("float")).otherwise(F.try_divide(a, b).cast("float"))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def single(x: Column, exact: bool) -> Column:
    return x.cast("float") if exact else x.cast("double")


def plain_text(x: Column) -> Column:
    """The shortest decimal text of a number without exponent and without a trailing ".0"; NaN as "NaN"."""
    short = x.cast("string")
    digits = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(x), F.lit("NaN")).when(short.contains("E"), digits).otherwise(F.regexp_replace(short, r"\.0$", ""))


def percentage(value: float) -> float:
    """An option given as a percentage (1 to 100) or as a fraction (0 to 1)."""
    if 1.0 <= value <= 100.0:
        return value / 100.0
    if 0.0 <= value < 1.0:
        return value
    raise ValueError(f"not a percentage: {value}")
