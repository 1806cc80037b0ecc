"""Outcomes of each sent offer inside that send's own window.

The earliest view at or after a send is inside the window, or no view is.  So a
minimum running backwards in time answers the window question with one sort per
(customer, offer) and never pairs sends with events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.functions.columns import COMPLETED, INFORMATIONAL, PURCHASE, RECEIVED, VIEWED, send_key
from offerscope.operators.cleaning import offer_terms
from offerscope.operators.timeline import Measure, hot_keys, is_hot, running
from offerscope.session import stage

#: A customer with more rows than this is cut into time buckets.  Below it one
#: task sorts the narrow rows faster than the cut pays for itself.
HOT_ROWS = 10_000_000
#: Width of such a bucket, in days.
BUCKET_DAYS = 1.0 / 24.0
# The flags of an instant and their kinds of events.
MARKS = {"__sent": RECEIVED, "__seen": VIEWED, "__done": COMPLETED}


def hot_customers(events: DataFrame, min_rows: int = HOT_ROWS) -> list[int]:
    return hot_keys(events, F.col("account_id"), min_rows)


def by_customer(df: DataFrame, hot: Sequence[int]) -> DataFrame:
    """Rows dealt out by ``customer_id`` once, so that sums and sorts by it and further columns need no exchange.

    With hot customers the rows stay where they are: one task would get all rows of such a customer.
    """
    return df if hot else df.repartition("customer_id")


def running_in_time(
    df: DataFrame, hot: Sequence[int], keys: Sequence[str], order: Sequence[str], measures: Sequence[Measure],
    inclusive: bool = False, descending: bool = False, width: float = BUCKET_DAYS,
) -> DataFrame:
    """Running aggregates per customer; a hot customer's rows are cut into time buckets.

    ``order`` starts with the time column.  With no hot customer the plan is one
    window and nothing else.
    """
    if not hot:
        return running(df, keys, order, measures, inclusive=inclusive, descending=descending)
    many = is_hot(hot, F.col("customer_id"))
    bucket = F.when(many, F.floor(F.col(order[0]) / F.lit(width))).otherwise(F.lit(0).cast("bigint"))
    return running(
        df.select("*", bucket.alias("__bucket")), keys, order, measures,
        bucket="__bucket", inclusive=inclusive, descending=descending, split=many,
    ).drop("__bucket")


def instant_rows(events: DataFrame, at: str) -> DataFrame:
    """Sends, views and completions as flags at their customer, offer and time."""
    return events.where(F.col("event").isin(*MARKS.values())).select(
        F.col("account_id").alias("customer_id"),
        "offer_id",
        F.col("time_since_test_start").alias(at),
        *[(F.col("event") == kind).alias(name) for name, kind in MARKS.items()],
    )


def attribute_outcomes(events: DataFrame, hot: Sequence[int] | None = None) -> DataFrame:
    """One row per distinct send with the first view and completion at or after it.

    Reads the log once.  Events of one instant collapse before the sort, which
    also removes exact duplicate sends.  A send without customer or offer is
    kept and has no outcome, as a null key matches nothing.
    """
    hot = hot_customers(events) if hot is None else hot
    instants = (
        by_customer(instant_rows(events, "t_received"), hot)
        .groupBy("customer_id", "offer_id", "t_received")
        .agg(*[F.max(name).alias(name) for name in MARKS])
    )
    keyed = F.col("customer_id").isNotNull() & F.col("offer_id").isNotNull()
    return (
        running_in_time(
            instants,
            hot,
            ["customer_id", "offer_id"],
            ["t_received"],
            [
                Measure("next_view", F.when(F.col("__seen"), F.col("t_received")), "min"),
                Measure("next_completion", F.when(F.col("__done"), F.col("t_received")), "min"),
            ],
            inclusive=True,
            descending=True,
        )
        .where("__sent")
        .select(
            "customer_id",
            "offer_id",
            "t_received",
            F.when(keyed, F.col("next_view")).alias("next_view"),
            F.when(keyed, F.col("next_completion")).alias("next_completion"),
        )
    )


def attribute_to_latest(events: DataFrame, hot: Sequence[int] | None = None) -> DataFrame:
    """The same, but every view and completion counts for one send only: the latest at or before it.

    All sends of one customer and offer have the same window, so if the latest is closed the
    earlier ones are closed too.  The latest send runs forwards in time past the events; what
    each send was given is then put together.
    """
    hot = hot_customers(events) if hot is None else hot
    instants = (
        by_customer(instant_rows(events, "__t"), hot)
        .groupBy("customer_id", "offer_id", "__t")
        .agg(*[F.max(name).alias(name) for name in MARKS])
    )
    keyed = F.col("customer_id").isNotNull() & F.col("offer_id").isNotNull()
    claimed = running_in_time(
        instants,
        hot,
        ["customer_id", "offer_id"],
        ["__t"],
        [Measure("t_received", F.when(F.col("__sent"), F.col("__t")), "max")],
        inclusive=True,
    ).where("t_received IS NOT NULL")
    return claimed.groupBy("customer_id", "offer_id", "t_received").agg(
        F.min(F.when(keyed & F.col("__seen"), F.col("__t"))).alias("next_view"),
        F.min(F.when(keyed & F.col("__done"), F.col("__t"))).alias("next_completion"),
    )


def close_windows(outcomes: DataFrame, offers: DataFrame) -> DataFrame:
    """Attach the offer's terms and keep the outcomes that fall inside its window."""
    ends = F.col("t_received") + F.col("duration")
    in_window = {t: F.col(f"next_{event}") <= ends for t, event in (("viewed", "view"), ("completed", "completion"))}
    return outcomes.join(offer_terms(offers), "offer_id", "left").select(
        send_key(F.col("customer_id"), F.col("offer_id"), F.col("t_received")).alias("opp_id"),
        "customer_id",
        "offer_id",
        "offer_type",
        "min_value",
        "duration",
        "discount_value",
        "channels",
        "t_received",
        ends.alias("t_expires"),
        F.round("t_received").cast("int").alias("round_day"),
        F.when(in_window["viewed"], F.col("next_view")).alias("t_viewed"),
        F.when(in_window["completed"], F.col("next_completion")).alias("t_completed"),
        *[F.coalesce(hit, F.lit(False)).cast("int").alias(name) for name, hit in in_window.items()],
    )


def informational_success(sends: DataFrame, events: DataFrame, hot: Sequence[int] | None = None) -> DataFrame:
    """Flag informational sends followed, after the view, by a purchase in the window.

    Sends are placed among the customer's purchases at the time of their view;
    the purchase time running backwards past them is the first one after it.
    Other offer types, and sends of an unknown offer, get null.
    """
    hot = hot_customers(events) if hot is None else hot
    bought = events.where((F.col("event") == PURCHASE) & F.col("account_id").isNotNull()).select(
        F.col("account_id").alias("customer_id"), F.col("time_since_test_start").alias("__at")
    )
    purchases = by_customer(bought, hot).distinct().withColumn("__purchase", F.lit(1))
    placed = sends.withColumn("__at", F.coalesce("t_viewed", "t_received")).withColumn("__purchase", F.lit(0))
    line = placed.unionByName(purchases, allowMissingColumns=True)
    followed = running_in_time(
        line,
        hot,
        ["customer_id"],
        ["__at", "__purchase"],
        [Measure("__next", F.when(F.col("__purchase") == 1, F.col("__at")), "min")],
        inclusive=True,
        descending=True,
    ).where("__purchase = 0")
    worked = (
        F.col("customer_id").isNotNull()
        & F.col("t_viewed").isNotNull()
        & (F.col("__next") <= F.col("t_expires"))
    )
    return followed.select(
        *sends.columns,
        F.when(F.col("offer_type") == INFORMATIONAL, F.coalesce(worked.cast("int"), F.lit(0))).alias(
            "informational_success"
        ),
    )


def attach_profile(sends: DataFrame, profile: DataFrame) -> DataFrame:
    customer = profile.select(
        F.col("id").alias("customer_id"), "age", "gender", "credit_card_limit", "registered_on_date"
    )
    return sends.join(customer, "customer_id", "left")


OPPORTUNITY_COLUMNS = (
    "opp_id",
    "customer_id",
    "offer_id",
    "offer_type",
    "duration",
    "age",
    "gender",
    "credit_card_limit",
    "registered_on_date",
    "min_value",
    "discount_value",
    "channels",
    "t_received",
    "t_expires",
    "round_day",
    "t_viewed",
    "t_completed",
    "viewed",
    "completed",
    "informational_success",
)


#: What an event inside the windows of several sends of one offer counts for.
SHARED, LATEST_SEND = "shared", "latest_send"


def opportunities(
    events: DataFrame,
    offers: DataFrame,
    profile: DataFrame,
    hot: Sequence[int] | None = None,
    dedupe: str = SHARED,
) -> DataFrame:
    """The opportunity table: one row per distinct send, with outcomes and attributes.

    An event inside the windows of several sends counts for all of them (``shared``) or for the
    ``latest_send``.  Customer attributes come last, so the sorts above move narrow rows only.
    """
    hot = hot_customers(events) if hot is None else hot
    claim = {SHARED: attribute_outcomes, LATEST_SEND: attribute_to_latest}[dedupe]
    sends = close_windows(claim(events, hot), offers)
    if hot:
        # the cut below reads its input twice
        sends = stage(sends, "sends")
    judged = informational_success(sends, events, hot)
    return attach_profile(judged, profile).select(*OPPORTUNITY_COLUMNS)


def attribution_by_join(events: DataFrame, offers: DataFrame) -> DataFrame:
    """The same outcomes by joining sends to events and taking the minimum.

    Kept as a check of the window form: it pairs every send with every event of
    its key, so use it on small inputs only.
    """
    t = F.col("time_since_test_start")
    key = ["customer_id", "offer_id"]
    named = events.withColumnRenamed("account_id", "customer_id")
    at = lambda kind, name: named.where(F.col("event") == kind).select(*key, t.alias(name))
    out = close_windows(
        at(RECEIVED, "t_received")
        .distinct()
        .withColumn("next_view", F.lit(None).cast("double"))
        .withColumn("next_completion", F.lit(None).cast("double")),
        offers,
    ).select("opp_id", *key, "t_received", "t_expires")
    for kind, name in ((VIEWED, "t_viewed"), (COMPLETED, "t_completed")):
        first = (
            out.join(at(kind, "__t"), key)
            .where(F.col("__t").between(F.col("t_received"), F.col("t_expires")))
            .groupBy("opp_id")
            .agg(F.min("__t").alias(name))
        )
        out = out.join(first, "opp_id", "left")
    return out
