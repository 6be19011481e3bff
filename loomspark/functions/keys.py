"""Key normalisation and stable hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(c: Column | str) -> Column:
    """Normal form of a key: blanks, tabs and line ends cut at both ends, lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


def bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def text_hash(c: Column) -> Column:
    """128 bits of a text, for comparing texts without shuffling them."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c, F.length(c)).alias("b"))
