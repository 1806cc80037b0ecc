"""Small column expressions: bands, labels, keys, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event names, offer types, channels, genders and age bands of the data model.
RECEIVED = "offer received"
VIEWED = "offer viewed"
COMPLETED = "offer completed"
PURCHASE = "transaction"
INFORMATIONAL = "informational"
COMPLETABLE_TYPES = ("bogo", "discount")
CHANNELS = ("email", "mobile", "web", "social")
UNKNOWN = "Unknown"
GENDERS = ("F", "M", "O", UNKNOWN)
AGE_SENTINEL = 118
AGE_UPPER_BOUNDS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
AGE_LAST_BAND = "65+"
AGE_BANDS = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+", UNKNOWN)
SEND_ROUNDS = (0, 7, 14, 17, 21, 24)


def completable(offer_type: str = "offer_type") -> Column:
    """Offers that can be completed; informational ones cannot."""
    return F.col(offer_type).isin(*COMPLETABLE_TYPES)


def age_band(age: Column) -> Column:
    band = F.when(age.isNull(), UNKNOWN)
    for bound, label in AGE_UPPER_BOUNDS:
        band = band.when(age < bound, label)
    return band.otherwise(AGE_LAST_BAND)


def success(offer_type: Column, completed: Column, informational_success: Column) -> Column:
    """1 if the send worked, by the rule that applies to its offer type."""
    return F.when(offer_type == INFORMATIONAL, informational_success).otherwise(completed)


def send_key(customer: Column, offer: Column, t: Column) -> Column:
    """Key of a send that is the same on every run and under any partitioning.

    Time enters as whole microseconds, so the text does not depend on how an
    engine prints a double.  Missing parts get their own mark.
    """
    micros = F.round(t * F.lit(86400e6)).cast("bigint").cast("string")
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in (customer, offer, micros)]))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is missing or not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
