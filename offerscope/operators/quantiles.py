"""Exact quantiles of large columns.

A sketch says between which two values each wanted position lies, to within its own error.  Values
outside are only counted.  Those inside are narrowed again in the same way until they are few, or
until ties leave nothing to narrow; only then are they counted by value and put in order.  Each pass
is a partial aggregation, whatever the size of the column, and no task holds or sorts it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketch is 1 / ACCURACY.
ACCURACY = 10_000
#: Values between two bounds that are put in order.
FEW = 100_000
#: Groups whose bounds are held on the driver.
MAX_GROUPS = 10_000


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, column): the keys, ``feature`` and ``value`` without nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(pairs)).where("value IS NOT NULL")


def _by_group(df: DataFrame, group: Sequence[str], entries: Mapping[tuple, Mapping[str, tuple]], shape: str) -> Column:
    """The entry of each row's own group, by name: a constant map of a few numbers per group."""
    key = df.select(F.struct(*group).alias("k")).schema["k"].dataType
    schema = f"k {key.simpleString()}, b map<string, struct<{shape}>>"
    frame = df.sparkSession.createDataFrame([(k, dict(of)) for k, of in entries.items()], schema)
    known = frame.agg(F.map_from_entries(F.collect_list(F.struct("k", "b")))).scalar()
    return F.try_element_at(known, F.struct(*group))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int = ACCURACY,
    few: int = FEW,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per key and feature.

    Output columns are named by ``probabilities``; ``n`` counts the values.
    """
    group = [*keys, "feature"]
    values = melt(df, keys, columns)
    names = list(probabilities)
    shares = [probabilities[name] for name in names]
    # wanted position +- 2 errors of the sketch, for every probability
    ends = sorted({min(1.0, max(0.0, p + side * 2.0 / accuracy)) for p in shares for side in (-1, 1)})
    first = (
        values.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", ends, accuracy).alias("edges"))
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(first) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of quantiles")
    totals = {tuple(r[c] for c in group): r["n"] for r in first}
    bounds: dict[tuple, dict[str, tuple[float, float]]] = {}
    for r in first:
        of = bounds.setdefault(tuple(r[c] for c in group), {})
        for name, p in zip(names, shares):
            low, high = p - 2.0 / accuracy, p + 2.0 / accuracy
            of[name] = (
                r["least"] if low <= 0 or r["n"] <= few else r["edges"][ends.index(low)],
                r["most"] if high >= 1 or r["n"] <= few else r["edges"][ends.index(high)],
            )
    ends_of = {tuple(r[c] for c in group): (r["least"], r["most"]) for r in first}
    margin = max(1.0, 200.0 / accuracy)
    settled: set[tuple] = set()

    while True:
        own = _by_group(values, group, bounds, "low: double, high: double")
        placed = values.select("*", own.alias("__b")).select(*group, "value", *[F.col("__b")[n].alias(f"__{n}") for n in names])
        inside = {n: F.col("value").between(F.col(f"__{n}.low"), F.col(f"__{n}.high")) for n in names}
        if all(n <= few for n in totals.values()):  # few to begin with: the bounds hold them all
            found = {k: {n: {"below": 0} for n in names} for k in totals}
            break
        counted = placed.groupBy(*group).agg(
            *[
                F.struct(
                    F.count_if(F.col("value") < F.col(f"__{n}.low")).alias("below"),
                    F.count_if(inside[n]).alias("inside"),
                    F.percentile_approx(F.when(inside[n], F.col("value")), [i / 100 for i in range(1, 100)], accuracy).alias("edges"),
                ).alias(n)
                for n in names
            ]
        )
        found = {tuple(r[c] for c in group): r for r in counted.collect()}
        again = False
        for k, of in bounds.items():
            for n, p in zip(names, shares):
                low, high = of[n]
                seen = found[k][n]
                wanted = p * (totals[k] - 1)
                if not seen["below"] <= math.floor(wanted) <= math.ceil(wanted) < seen["below"] + seen["inside"]:
                    # a bound missed its position: take everything
                    of[n], again = ends_of[k], True
                    settled.add((k, n))
                    continue
                if seen["inside"] <= few or low == high or (k, n) in settled:
                    continue
                # a hundredth or the sketch's error on either side of where the position lies inside
                at = (wanted - seen["below"]) / seen["inside"] * 100
                a, b = math.floor(at - margin), math.ceil(at + margin) + 1
                edges = seen["edges"]
                narrowed = (edges[a - 1] if 1 <= a <= 99 else low, edges[b - 1] if 1 <= b <= 99 else high)
                if narrowed != (low, high):
                    of[n], again = narrowed, True
        if not again:
            break

    # few values, or few different ones, between the bounds: count them, put them in order, pick
    inside_any = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), inside[n].alias("hit")) for n in names]), lambda e: e["hit"]
    )
    kept = placed.select(*group, "value", F.inline(inside_any)).groupBy(*group, "name", "value").agg(F.count(F.lit(1)).alias("m"))
    starts = {
        k: {n: (totals[k], r[n]["below"], p * (totals[k] - 1)) for n, p in zip(names, shares)} for k, r in found.items()
    }
    before = Window.partitionBy(*group, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    start = _by_group(kept, group, starts, "n_all: long, below: long, position: double")
    ordered = kept.select("*", start.alias("__s")).select(
        *group, "name", "value", "m", F.col("__s")[F.col("name")].alias("__s"),
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__before"),
    )
    low = F.col("__s.below") + F.col("__before")
    holds = lambda at: (low <= at) & (at < low + F.col("m"))
    value = lambda n, at: F.max(F.when((F.col("name") == n) & holds(at), F.col("value")))
    position = F.col("__s.position")
    picked = ordered.groupBy(*group).agg(
        F.max("__s.n_all").alias("n"),
        *[value(n, step(position)).alias(f"__{n}_{side}") for n in names for side, step in (("lo", F.floor), ("hi", F.ceil))],
    )
    blended = []
    for n, p in zip(names, shares):
        at = F.lit(p) * (F.col("n") - 1)
        blended.append((F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * (at - F.floor(at))).alias(n))
    return picked.select(*group, "n", *blended)
