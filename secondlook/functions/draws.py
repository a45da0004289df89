"""Reproducible random draws: a hash of (seed, purpose, row key), never a generator with state.

The same row gets the same draw whatever the partitioning, the executor or the retry.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 28


def draw_bits(seed: int, purpose: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def draw_unit(seed: int, purpose: str, key: Column) -> Column:
    """A double in [0, 1)."""
    return draw_bits(seed, purpose, key) / F.lit(float(1 << BITS))


def draw_int(seed: int, purpose: str, key: Column, n) -> Column:
    """An integer in [0, n); ``n`` may be a Column."""
    return draw_bits(seed, purpose, key) % (n if isinstance(n, Column) else F.lit(n).cast("bigint"))
