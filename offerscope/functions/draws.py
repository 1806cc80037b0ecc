"""Random numbers as a pure function of a row's own key.

``rand(seed)`` changes with the partitioning; these do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(digest: Column, start: int) -> Column:
    """Eight hex digits of a digest as a whole number below 2**32."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def pick(key: Column, n: int) -> Column:
    """Whole number in [0, n)."""
    return (_word(F.md5(key), 1) % n).cast("int")


def uniform(key: Column) -> Column:
    """Double in (0, 1)."""
    return (_word(F.md5(key), 1) + 0.5) / F.lit(4294967296.0)


def normal(key: Column) -> Column:
    """Standard normal by the Box-Muller transform of two words of one digest."""
    digest = F.md5(key)
    u, v = ((_word(digest, start) + 0.5) / F.lit(4294967296.0) for start in (1, 9))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
