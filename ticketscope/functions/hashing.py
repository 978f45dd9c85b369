"""Row choice by key hash: the same rows are chosen whatever the partitioning, and on every retry."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(2**32)

# One salt per purpose, so that a sample of a sample is a fresh choice.
ISSUES, BALANCE, CLUSTERS, SIZE, SAMPLE = "issues", "balance", "clusters", "size", "sample"


def key_fraction(key: str | Column, salt: str) -> Column:
    """The key's position in [0, 1), spread evenly by the first 32 bits of its md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(_RANGE)
