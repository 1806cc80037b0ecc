"""Funnel, segment, cohort and spend tables.

One helper covers most of them: group, average the 0/1 outcomes, count.  Spark
sums on the map side first, so a group with most of the rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.columns import (
    AGE_BANDS,
    COMPLETED,
    GENDERS,
    INFORMATIONAL,
    PURCHASE,
    VIEWED,
    age_band,
    completable,
)
from offerscope.operators.attribution import running_in_time
from offerscope.operators.timeline import Measure



def rate_by(
    df: DataFrame, keys: Sequence[str | Column], rates: Mapping[str, str | Column], count: str = "n"
) -> DataFrame:
    """Averages (nulls left out) and the row count per group."""
    return df.groupBy(*keys).agg(
        *[F.avg(source).alias(name) for name, source in rates.items()], F.count(F.lit(1)).alias(count)
    )


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return rate_by(df, keys, {})


def with_age_group(df: DataFrame, age: str = "age") -> DataFrame:
    return df.withColumn("age_group", age_band(F.col(age)))


def in_order(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """All levels in their own order, those without rows included.

    The levels are a fixed short list, so the join side is its literal rows.
    """
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in levels])).alias("position", column))
    return wanted.join(df, column, "left").orderBy("position")


# -- customers and offers ---------------------------------------------------------------


def profile_by_gender(profile: DataFrame) -> DataFrame:
    counted = in_order(count_by(profile, "gender"), "gender", GENDERS)
    return counted.select("gender", "position", F.coalesce("n", F.lit(0)).alias("n"))


def offers_by_channel(offers: DataFrame) -> DataFrame:
    return count_by(offers.select(F.explode("channels").alias("channel")), "channel").orderBy(F.desc("n"), "channel")


def limit_by_age(profile: DataFrame) -> DataFrame:
    banded = rate_by(with_age_group(profile), ["age_group"], {"avg_limit": "credit_card_limit"})
    return in_order(banded, "age_group", AGE_BANDS).select(
        "age_group", "position", "avg_limit", F.coalesce("n", F.lit(0)).alias("n")
    )


# -- the log and the sends --------------------------------------------------------------


def events_by_type(events: DataFrame) -> DataFrame:
    return count_by(events, "event").orderBy(F.desc("n"), "event")


def sends_by_round(opps: DataFrame) -> DataFrame:
    return count_by(opps, "round_day").orderBy("round_day")


def funnel_by_type(opps: DataFrame) -> DataFrame:
    return rate_by(
        opps,
        ["offer_type"],
        {
            "view_rate": "viewed",
            "completion_rate": "completed",
            "informational_success_rate": "informational_success",
        },
    ).orderBy("offer_type")


def funnel_by_offer(opps: DataFrame) -> DataFrame:
    return rate_by(
        opps,
        ["offer_id", "offer_type", "discount_value", "min_value", "duration"],
        {"view_rate": "viewed", "completion_rate": "completed"},
    ).orderBy("offer_type", F.desc("completion_rate"), "offer_id")


def _finished(opps: DataFrame) -> DataFrame:
    return opps.where(completable() & (F.col("completed") == 1))


def organic_share(opps: DataFrame) -> DataFrame:
    """Completions without a view in the window, in one pass."""
    unseen = F.count_if(F.col("viewed") == 0)
    n = F.count(F.lit(1))
    return _finished(opps).agg(
        n.alias("n_completed"),
        unseen.alias("n_organic"),
        (unseen / F.nullif(n, F.lit(0))).alias("organic_share"),
    )


def organic_by_segment(opps: DataFrame) -> DataFrame:
    """Organic rate by gender and by age band, from one scan with two grouping sets."""
    banded = with_age_group(_finished(opps))
    return (
        banded.groupingSets([["gender"], ["age_group"]], "gender", "age_group")
        .agg(
            F.grouping("gender").alias("by_age"),
            F.avg((F.col("viewed") == 0).cast("int")).alias("organic_rate"),
            F.count(F.lit(1)).alias("n_completed"),
        )
        .select(
            F.when(F.col("by_age") == 0, "gender").otherwise("age_group").alias("segment"),
            F.when(F.col("by_age") == 0, F.col("gender")).otherwise(F.col("age_group")).alias("level"),
            "organic_rate",
            "n_completed",
        )
    )


def completion_by_duration(opps: DataFrame) -> DataFrame:
    return rate_by(opps.where(completable()), ["duration", "offer_type"], {"completion_rate": "completed"}).orderBy(
        "duration", "offer_type"
    )


def completion_by_channel(opps: DataFrame) -> DataFrame:
    """By channel and offer type.

    The channel set belongs to the offer, so rows are first summed per set and
    type and only those few sums are exploded.
    """
    per_set = opps.groupBy("offer_type", "channels").agg(
        F.sum("completed").alias("done"), F.count(F.lit(1)).alias("sent")
    )
    return (
        per_set.select("offer_type", F.explode("channels").alias("channel"), "done", "sent")
        .groupBy("offer_type", "channel")
        .agg((F.sum("done") / F.sum("sent")).alias("completion_rate"), F.sum("sent").alias("n"))
        .orderBy("offer_type", "channel")
    )


def completion_channel_pivot(opps: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row per channel, one completion-rate column per offer type."""
    return (
        completion_by_channel(opps)
        .groupBy("channel")
        .pivot("offer_type", list(types))
        .agg(F.first("completion_rate"))
    )


def converter_profile(opps: DataFrame) -> DataFrame:
    return rate_by(
        opps.where(completable()), ["completed"], {"avg_age": "age", "avg_credit_limit": "credit_card_limit"}
    )


def completion_gender_age(opps: DataFrame) -> DataFrame:
    return rate_by(with_age_group(opps.where(completable())), ["gender", "age_group"], {"completion_rate": "completed"})


def completion_heat_table(opps: DataFrame) -> DataFrame:
    """Gender by age band, every cell present in the fixed order, empty cells null."""
    cells = (
        with_age_group(opps.where(completable()))
        .groupBy("gender")
        .pivot("age_group", list(AGE_BANDS))
        .agg(F.avg("completed"))
    )
    return in_order(cells, "gender", GENDERS)


def completer_customers(opps: DataFrame) -> DataFrame:
    return _finished(opps).select("customer_id").where("customer_id IS NOT NULL").distinct()


def purchases(events: DataFrame) -> DataFrame:
    return events.where(F.col("event") == PURCHASE).select(F.col("account_id").alias("customer_id"), "amount")


def spend_by_user_group(events: DataFrame, opps: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Spend per purchase, by whether the customer ever completed an offer."""
    users = completer_customers(opps).withColumn("completer", F.lit(1))
    return (
        purchases(events)
        .join(users, "customer_id", "left")
        .groupBy(F.coalesce("completer", F.lit(0)).alias("is_offer_user"))
        .agg(
            F.avg("amount").alias("avg_amount"),
            F.percentile_approx("amount", 0.5, accuracy).alias("median_amount"),
            F.count(F.lit(1)).alias("n_transactions"),
        )
    )


def spend_ratios(summary: DataFrame) -> DataFrame:
    """Offer users over others: ratio of means and ratio of medians."""
    pick = lambda flag, c: F.max(F.when(F.col("is_offer_user") == flag, F.col(c)))
    return summary.agg(
        *[
            (pick(1, c) / F.nullif(pick(0, c), F.lit(0.0))).alias(name)
            for c, name in (("avg_amount", "mean_ratio"), ("median_amount", "median_ratio"))
        ]
    )


def weekly_events(events: DataFrame) -> DataFrame:
    """Views and completions per week, one column each, absent ones zero."""
    return (
        events.where(F.col("event").isin(VIEWED, COMPLETED))
        .groupBy((F.col("time_since_test_start") / 7).cast("int").alias("week"))
        .pivot("event", [COMPLETED, VIEWED])
        .count()
        .na.fill(0)
        .select("week", F.col(COMPLETED).alias("offer_completed"), F.col(VIEWED).alias("offer_viewed"))
        .orderBy("week")
    )


def completion_by_cohort(opps: DataFrame) -> DataFrame:
    return rate_by(
        opps.where(completable()),
        [F.year("registered_on_date").alias("reg_year")],
        {"completion_rate": "completed"},
    ).orderBy("reg_year")


# -- repeated sends ---------------------------------------------------------------------


def repeat_groups(opps: DataFrame) -> DataFrame:
    """Number of (customer, offer) pairs with more than one send."""
    return count_by(opps, "customer_id", "offer_id").where("n > 1").agg(F.count(F.lit(1)).alias("n_repeat_groups"))


def send_rank(opps: DataFrame, hot: Sequence[int] = ()) -> DataFrame:
    """Number of each send within its (customer, offer), by time.

    Sends are distinct in time within their pair, so the number is a running count.
    """
    return running_in_time(
        opps,
        hot,
        ["customer_id", "offer_id"],
        ["t_received"],
        [Measure("instance_rank", F.lit(1).cast("bigint"))],
        inclusive=True,
    )


def first_vs_repeat(opps: DataFrame, hot: Sequence[int] = ()) -> DataFrame:
    return rate_by(
        send_rank(opps.where(completable()), hot),
        [(F.col("instance_rank") == 1).alias("is_first_instance")],
        {"completion_rate": "completed"},
    )


def informational_outcomes(opps: DataFrame) -> DataFrame:
    return count_by(opps.where(F.col("offer_type") == INFORMATIONAL), "viewed", "informational_success").orderBy(
        "viewed", "informational_success"
    )


# -- the context table ------------------------------------------------------------------


def arm_distribution(contexts: DataFrame) -> DataFrame:
    return rate_by(contexts, ["offer_id", "offer_type"], {"reward_rate": "reward"}).orderBy("offer_type", "offer_id")


def best_offer(contexts: DataFrame) -> DataFrame:
    """The offer with the highest success rate; the smallest id among equals."""
    return (
        rate_by(contexts, ["offer_id"], {"reward_rate": "reward"})
        .orderBy(F.desc("reward_rate"), "offer_id")
        .limit(1)
    )


def completer_ticket(events: DataFrame, opps: DataFrame) -> DataFrame:
    """Mean purchase of customers who completed at least one offer."""
    return (
        purchases(events)
        .join(completer_customers(opps), "customer_id", "left_semi")
        .agg(F.avg("amount").alias("avg_ticket"))
    )


def most_recent_active(contexts: DataFrame, k: int = 10) -> DataFrame:
    """The k sends closest after the customer's last purchase."""
    return contexts.orderBy("days_since_last_tx", "opp_id").limit(k)
