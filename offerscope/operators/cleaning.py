"""Cleaning of the raw inputs and the joined event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.functions.columns import AGE_SENTINEL, GENDERS, UNKNOWN


def clean_profile(profile: DataFrame) -> DataFrame:
    """One row per customer: sentinel age to null, gender to a fixed set, date parsed.

    A date that does not parse becomes null instead of failing the job.
    """
    gender = F.upper(F.trim("gender"))
    return profile.select(
        "id",
        F.nullif(F.col("age").try_cast("int"), F.lit(AGE_SENTINEL)).alias("age"),
        F.when(gender.isin(*GENDERS[:-1]), gender).otherwise(UNKNOWN).alias("gender"),
        F.col("credit_card_limit").try_cast("double").alias("credit_card_limit"),
        F.try_to_date(F.col("registered_on").cast("string"), "yyyyMMdd").alias("registered_on_date"),
    )


def flatten_transactions(transactions: DataFrame) -> DataFrame:
    """Lift the nested value to columns; the offer key has two spellings."""
    kept = [c for c in transactions.columns if c not in ("value", "time_since_test_start")]
    return transactions.select(
        *kept,
        F.col("time_since_test_start").try_cast("double").alias("time_since_test_start"),
        F.coalesce("value.offer_id", "value.`offer id`").alias("offer_id"),
        F.col("value.amount").try_cast("double").alias("amount"),
        F.col("value.reward").try_cast("double").alias("reward_amount"),
    )


def event_log(events: DataFrame, profile: DataFrame, offers: DataFrame) -> DataFrame:
    """Every event with its customer's and its offer's attributes.

    No join hint: Spark broadcasts a side whose size it knows to be small, and
    otherwise sort-merges with adaptive splitting of hot customers and offers.
    """
    customer = profile.select(
        F.col("id").alias("customer_id"), "age", "gender", "credit_card_limit", "registered_on_date"
    )
    return (
        events.withColumnRenamed("account_id", "customer_id")
        .join(customer, "customer_id", "left")
        .join(offer_terms(offers), "offer_id", "left")
        .select(
            "customer_id",
            "event",
            "time_since_test_start",
            "offer_id",
            "amount",
            "reward_amount",
            "age",
            "gender",
            "credit_card_limit",
            "registered_on_date",
            "offer_type",
            "min_value",
            "duration",
            "discount_value",
            "channels",
        )
    )


#: Rows up to which a dimension is sent to every task.
SMALL_ROWS = 10_000


def small_dimension(offers: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The offers as a local table that joins may broadcast, if there are few enough; else as they are.

    A join on a key of ten values would deal all events out to ten partitions.  The rows are counted
    as they are fetched, so what is broadcast is bounded; beyond the bound joins shuffle and adaptive
    execution splits hot offers.
    """
    rows = offers.limit(most + 1).collect()
    if len(rows) > most:
        return offers
    return F.broadcast(offers.sparkSession.createDataFrame(rows, offers.schema))


def offer_terms(offers: DataFrame) -> DataFrame:
    return offers.select(
        F.col("id").alias("offer_id"),
        "offer_type",
        "min_value",
        F.col("duration").cast("double").alias("duration"),
        "discount_value",
        "channels",
    )
