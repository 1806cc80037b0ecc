"""Running aggregates along an order, without putting a large group into one task.

A window over a key sorts that key's rows in one task.  Here the rows of a large
key are cut into *buckets* that follow the order.  Each bucket runs its own
window; a second, small window runs over one total per bucket; and the total of
all earlier buckets is joined back.  The answer is the same as that of a single
window, whatever the cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """A column aggregated along the order by ``how``: sum, min or max."""

    name: str
    value: Column
    how: str = "sum"

    def aggregate(self, value: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.how](value)

    def finish(self, value: Column) -> Column:
        """A sum over no rows is zero."""
        return F.coalesce(value, F.lit(0)) if self.how == "sum" else value

    def combine(self, left: Column, right: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
        return (F.least if self.how == "min" else F.greatest)(left, right)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Sequence[Measure],
    *,
    bucket: str | None = None,
    inclusive: bool = False,
    descending: bool = False,
    split: Column | None = None,
) -> DataFrame:
    """Add one column per measure: its aggregate over the key's rows up to this row.

    ``order`` must be free of ties between rows that contribute; ``bucket`` must
    follow it.  The row itself counts if ``inclusive``.  ``split`` marks the rows
    whose key has more than one bucket; others need no total carried over to
    them.  Without ``bucket`` each key is one window.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    parts = [*keys] if bucket is None else [*keys, bucket]
    inside = (
        Window.partitionBy(*parts)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    within = df.select("*", *[m.finish(m.aggregate(m.value).over(inside)).alias(m.name) for m in measures])
    if bucket is None:
        return within
    across = Window.partitionBy(*keys).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df if split is None else df.where(split)).groupBy(*parts).agg(
        *[m.aggregate(m.value).alias(m.name) for m in measures]
    )
    carried = totals.select(*parts, *[m.aggregate(F.col(m.name)).over(across).alias(f"__{m.name}") for m in measures])
    # null keys are groups of their own, so they must meet their totals too
    named = carried.select(*[F.col(p).alias(f"__at_{p}") for p in parts], *[f"__{m.name}" for m in measures])
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"__at_{p}")) for p in parts])
    return within.join(named, same, "left").select(
        *df.columns,
        *[m.combine(F.col(m.name), F.col(f"__{m.name}")).alias(m.name) for m in measures],
    )


def hot_keys(df: DataFrame, key: Column, min_rows: int) -> list[int]:
    """Hashes of the keys that hold more than ``min_rows`` rows.

    An exact count with partial sums on the map side; of n rows at most
    n / min_rows keys can come back.  The list decides only how the work is cut:
    a key named without need changes no result.
    """
    counts = df.groupBy(F.xxhash64(key).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["item"] for r in counts.where(F.col("n") > min_rows).select("item").collect())


def is_hot(hot: Sequence[int], key: Column) -> Column:
    return F.xxhash64(key).isin([F.lit(h) for h in hot])
