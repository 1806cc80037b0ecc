"""Attribution and labels while events arrive, as joins between streams.

All state is kept by Spark's own operators in the JVM: no Python runs per key.  A send meets the
outcomes of its customer and offer whose time lies in its window.  The longest duration of any
offer bounds every window, so that watermarks on both sides let state go; the send's own end is a
condition beside it.

Event time is a timestamp (``at``).  Sends and events without customer or offer match nothing.
Rows that arrive later than the watermark allows meet nothing any more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.columns import COMPLETED, INFORMATIONAL, PURCHASE, RECEIVED, VIEWED, send_key
from offerscope.operators.cleaning import offer_terms

DAY_MS = 86_400_000.0
#: Instant of day zero.  A watermark starts at the epoch and drops rows at or before it.
START_MS = 946_684_800_000
#: A kind of event without meaning but its time: it moves the watermark on when nothing else arrives.
HEARTBEAT = "heartbeat"


def instant(days: Column) -> Column:
    return F.timestamp_millis(F.round(days * F.lit(DAY_MS)).cast("bigint") + START_MS)


def longest_duration(offers: DataFrame) -> float:
    """In days; one number, so its collection is bounded."""
    return offers.agg(F.max(F.col("duration").cast("double"))).first()[0] or 0.0


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Flattened events with their event time and its watermark."""
    return events.where(F.col("time_since_test_start").isNotNull()).select(
        F.col("account_id").alias("customer_id"),
        "offer_id",
        "event",
        F.col("time_since_test_start").alias("t"),
        instant(F.col("time_since_test_start")).alias("at"),
    ).withWatermark("at", delay)


def heartbeat(events: DataFrame, offers: DataFrame, delay_days: float) -> DataFrame:
    """One row like ``events``, so late that every window of theirs is closed once it has been read.

    Each join of ``label_stream`` hands on a watermark that lies a window behind its own.
    """
    late = events.agg(F.max("time_since_test_start")).first()[0] or 0.0
    late += 4 * longest_duration(offers) + delay_days + 1.0
    given = {"event": F.lit(HEARTBEAT), "time_since_test_start": F.lit(late)}
    return events.sparkSession.range(1).select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    )


def of_kind(stream: DataFrame, *kinds: str) -> DataFrame:
    """Rows of some kinds.  The condition names the event time as well, so that it stays above the
    watermark: heartbeats and other kinds must move it on."""
    return stream.where(F.when(F.col("at").isNotNull(), F.col("event").isin(*kinds)))


def _sends(stream: DataFrame, offers: DataFrame) -> DataFrame:
    terms = offer_terms(offers).select("offer_id", "offer_type", "duration")
    return (
        of_kind(stream, RECEIVED)
        .join(terms, "offer_id", "left")
        .select(
            send_key(F.col("customer_id"), F.col("offer_id"), F.col("t")).alias("opp_id"),
            "customer_id",
            "offer_id",
            "offer_type",
            F.col("t").alias("t_received"),
            (F.col("t") + F.col("duration")).alias("t_expires"),
            "at",
        )
    )


def _outcomes(stream: DataFrame, *kinds: str) -> DataFrame:
    """Distinct instants of some kinds of events, under names of their own."""
    rows = of_kind(stream, *kinds).select(
        F.col("customer_id").alias("o_customer"), F.col("offer_id").alias("o_offer"), F.col("event").alias("o_event"),
        F.col("t").alias("o_t"), F.col("at").alias("o_at"),
    )
    return rows.dropDuplicatesWithinWatermark(["o_customer", "o_offer", "o_event", "o_t"])


def _within(start: str, end: str, days: float) -> Column:
    """``end`` is at or after ``start`` and no more than ``days`` later: what state may be kept for."""
    width = F.expr(f"INTERVAL {math.ceil(days * 86_400) + 1} SECONDS")
    return (F.col(end) >= F.col(start)) & (F.col(end) <= F.col(start) + width)


def attribute_stream(events: DataFrame, offers: DataFrame, delay: str = "30 days") -> DataFrame:
    """Every send as it arrives, and again with each outcome inside its window.

    customer_id, offer_id, t_received, t_expires, t_viewed, t_completed: ``latest`` of what has come out
    is the batch answer.  ``delay`` is how late an event may arrive.
    """
    longest = longest_duration(offers)
    stream = timed(events, delay)
    sends = _sends(stream, offers)
    nothing = F.lit(None).cast("double")
    columns = ["customer_id", "offer_id", "t_received", "t_expires"]
    met = sends.where(F.col("t_expires").isNotNull()).join(
        _outcomes(stream, VIEWED, COMPLETED),
        (F.col("customer_id") == F.col("o_customer"))
        & (F.col("offer_id") == F.col("o_offer"))
        & _within("at", "o_at", longest)
        & F.col("o_t").between(F.col("t_received"), F.col("t_expires")),
    )
    hits = [F.when(F.col("o_event") == kind, F.col("o_t")).alias(n) for kind, n in ((VIEWED, "t_viewed"), (COMPLETED, "t_completed"))]
    return sends.select(*columns, nothing.alias("t_viewed"), nothing.alias("t_completed")).unionByName(
        met.select(*columns, *hits)
    )


def latest(emitted: DataFrame) -> DataFrame:
    """Every send with the first view and completion that came out for it."""
    return emitted.groupBy("customer_id", "offer_id", "t_received", "t_expires").agg(
        F.min("t_viewed").alias("t_viewed"), F.min("t_completed").alias("t_completed")
    )


def label_stream(events: DataFrame, offers: DataFrame, delay: str = "30 days") -> DataFrame:
    """The success label of every send, once: 1 or 0 when the watermark has passed its window.

    An offer that can be completed succeeds by a completion in its window; an informational one by
    a view in it and a purchase from then on, still in it.  View and purchase are two joins in a row:
    what a view leaves open waits for a purchase of the same customer.  opp_id, customer_id,
    offer_id, t_received, reward.
    """
    longest = longest_duration(offers)
    stream = timed(events, delay)
    sends = _sends(stream, offers).dropDuplicatesWithinWatermark(["opp_id"])
    informational = F.coalesce(F.col("offer_type") == INFORMATIONAL, F.lit(False))
    own = (F.col("customer_id") == F.col("o_customer")) & (F.col("offer_id") == F.col("o_offer"))
    in_window = _within("at", "o_at", longest) & F.col("o_t").between(F.col("t_received"), F.col("t_expires"))

    completed = (
        sends.where(~informational).join(_outcomes(stream, COMPLETED), own & in_window)
        .select("opp_id", F.col("o_at").alias("s_at"))
    )
    viewed = (
        sends.where(informational).join(_outcomes(stream, VIEWED), own & in_window)
        .select("opp_id", "customer_id", F.col("o_t").alias("t_viewed"), "t_expires", F.col("o_at").alias("v_at"))
    )
    bought = _outcomes(stream, PURCHASE)
    followed = viewed.join(
        bought,
        (F.col("customer_id") == F.col("o_customer"))
        & _within("v_at", "o_at", longest)
        & F.col("o_t").between(F.col("t_viewed"), F.col("t_expires")),
    ).select("opp_id", F.col("o_at").alias("s_at"))
    successes = (
        completed.unionByName(followed)
        .dropDuplicatesWithinWatermark(["opp_id"])
        .withColumnRenamed("opp_id", "s_opp")
    )
    labelled = sends.join(successes, (F.col("opp_id") == F.col("s_opp")) & _within("at", "s_at", longest), "left_outer")
    return labelled.select(
        "opp_id", "customer_id", "offer_id", "t_received", F.col("s_opp").isNotNull().cast("int").alias("reward")
    )
