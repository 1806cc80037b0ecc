"""Data-quality checks and descriptive statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.functions.columns import COMPLETED, RECEIVED, SEND_ROUNDS, UNKNOWN
from offerscope.operators.quantiles import exact_quantiles, melt


def unpivot_row(row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn one wide row of like-typed columns into (name, value) rows."""
    return row.unpivot([], list(columns), name, value)


def null_profile(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Null count and share per column; each table is scanned once for all its columns."""
    parts = []
    for table, (df, columns) in tables.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
        )
        parts.append(
            counts.unpivot(["__n"], list(columns), "column_name", "n_null").select(
                F.lit(table).alias("table_name"),
                "column_name",
                F.col("__n").alias("n_rows"),
                "n_null",
                (F.col("n_null") / F.nullif("__n", F.lit(0))).alias("null_share"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def incomplete_share(profile: DataFrame) -> DataFrame:
    """Customers without age, gender or limit."""
    missing = F.count_if(F.col("age").isNull())
    n = F.count(F.lit(1))
    return profile.agg(
        n.alias("n_total"),
        missing.alias("age_null"),
        F.count_if(F.col("gender") == UNKNOWN).alias("gender_unknown"),
        F.count_if(F.col("credit_card_limit").isNull()).alias("limit_null"),
        (missing / F.nullif(n, F.lit(0))).alias("incomplete_share"),
    )


def row_conservation(events: DataFrame, log: DataFrame, opps: DataFrame) -> DataFrame:
    """Events in, log rows out; distinct sends in, opportunities out."""
    sent = events.where(F.col("event") == RECEIVED)
    distinct_sends = sent.select("account_id", "offer_id", "time_since_test_start").distinct()
    counts = {
        "n_events": events,
        "n_log_rows": log,
        "n_send_events": sent,
        "n_distinct_sends": distinct_sends,
        "n_opportunities": opps,
    }
    spark = events.sparkSession
    return spark.range(1).select(
        *[df.agg(F.count(F.lit(1))).scalar().alias(name) for name, df in counts.items()]
    )


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Number of key values that occur more than once; zero if the key is unique."""
    return df.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_duplicate_keys"))


def reward_matches_discount(log: DataFrame) -> DataFrame:
    """Completions by whether the reward paid equals the offer's discount (null: unknown)."""
    return (
        log.where(F.col("event") == COMPLETED)
        .groupBy((F.col("reward_amount") == F.col("discount_value")).alias("matches"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def completion_overcount(events: DataFrame, opps: DataFrame) -> DataFrame:
    """Completion events against completed sends; overlapping windows share events."""
    raw = events.where(F.col("event") == COMPLETED).agg(F.count(F.lit(1))).scalar()
    return opps.agg(F.coalesce(F.sum("completed"), F.lit(0)).alias("attributed_completions")).select(
        raw.alias("raw_completions"),
        "attributed_completions",
        (F.col("attributed_completions") - raw).alias("difference"),
    )


def round_check(opps: DataFrame, expected: Sequence[int] = SEND_ROUNDS) -> DataFrame:
    """Observed and expected send rounds side by side."""
    wanted = opps.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in expected])).alias("round_day"), F.lit(True).alias("__expected")
    )
    seen = opps.groupBy("round_day").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(seen, "round_day", "full").select(
        "round_day",
        F.coalesce("__expected", F.lit(False)).cast("int").alias("expected"),
        F.col("n").isNotNull().cast("int").alias("observed"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return unpivot_row(counts, columns, "column_name", "n_null")


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail, with the columns' names, if any of them holds a null."""
    bad = [r["column_name"] for r in null_counts(df, columns).where("n_null > 0").collect()]
    if bad:
        raise ValueError(f"null values in feature columns: {', '.join(sorted(bad))}")
    return df


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    moments = (
        melt(df, [], columns)
        .groupBy("feature")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    )
    return exact_quantiles(df, columns, QUARTILES).join(moments, "feature")


def feature_quartiles(contexts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Box-plot figures of each feature, for failed and successful sends."""
    return exact_quantiles(contexts, columns, QUARTILES, keys=["reward"])


def assignment_balance(opps: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """How far each offer's customers differ from all: standardised mean difference.

    Near-zero differences everywhere are what random assignment looks like.
    """
    long = melt(opps, ["offer_id"], covariates)
    sets = long.groupingSets([["offer_id", "feature"], ["feature"]], "offer_id", "feature").agg(
        F.grouping("offer_id").alias("whole"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    overall = sets.where("whole = 1").select(
        "feature", F.col("mean").alias("overall_mean"), F.col("sd").alias("overall_sd")
    )
    return (
        sets.where("whole = 0")
        .join(overall, "feature")
        .select(
            "offer_id",
            "feature",
            "n",
            "mean",
            "sd",
            ((F.col("mean") - F.col("overall_mean")) / F.nullif("overall_sd", F.lit(0.0))).alias("std_difference"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last one is closed on the right."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    low = F.col("__ends.lo")
    width = (F.col("__ends.hi") - low) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("__v") - low) / width), F.lit(bins - 1))).otherwise(0)
    return (
        df.where(value.isNotNull())
        .select(value.alias("__v"), ends.alias("__ends"))
        .groupBy(number.cast("int").alias("bin"), "__ends")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (low + F.col("bin") * width).alias("bin_start"), "n")
        .orderBy("bin")
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns.

    Spark ML adds the products up per partition; only the columns-by-columns
    matrix reaches the driver.  A constant column has no correlation: null.
    """
    vectors = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    pairs = [
        (a, b, None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return df.sparkSession.createDataFrame(pairs, "feature_a string, feature_b string, r double")
