"""Point-in-time features of each opportunity, and the design rows built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.functions.columns import (
    CHANNELS,
    COMPLETED,
    GENDERS,
    PURCHASE,
    RECEIVED,
    UNKNOWN,
    VIEWED,
    ratio,
    success,
)
from offerscope.operators.attribution import by_customer, hot_customers, running_in_time
from offerscope.operators.timeline import Measure

# Columns that are keys, outcomes, or properties of the offer that was sent.
KEY_COLUMNS = ("opp_id", "customer_id", "offer_id", "offer_type", "t_received", "round_day")
OUTCOME_COLUMNS = ("viewed", "completed", "informational_success", "reward")
OFFER_COLUMNS = (
    "discount_value",
    "min_value",
    "offer_duration_days",
    "offer_reward_ratio",
    *[f"channel_is_{c}" for c in CHANNELS],
)
# Fixed value: days assumed since an event that never happened, just past the test's span.
NEVER_DAYS = 30.0


def base_columns() -> list[Column]:
    return [
        *[F.col(c) for c in (*KEY_COLUMNS, "viewed", "completed", "informational_success")],
        success(F.col("offer_type"), F.col("completed"), F.col("informational_success")).alias("reward"),
        F.col("discount_value"),
        F.col("min_value"),
    ]


def offer_columns() -> list[Column]:
    return [
        F.col("duration").cast("double").alias("offer_duration_days"),
        F.coalesce(ratio(F.col("discount_value"), F.col("min_value")), F.lit(0.0)).alias("offer_reward_ratio"),
    ]


def channel_columns() -> list[Column]:
    return [
        F.coalesce(F.array_contains("channels", c), F.lit(False)).cast("int").alias(f"channel_is_{c}")
        for c in CHANNELS
    ]


def profile_columns() -> list[Column]:
    return [
        F.col("age").cast("double").alias("customer_age"),
        F.coalesce("gender", F.lit(UNKNOWN)).alias("customer_gender"),
        F.col("credit_card_limit").cast("double").alias("customer_credit_limit"),
        F.col("age").isNull().cast("int").alias("customer_incomplete_profile"),
    ]


def reference_date(events: DataFrame, profile: DataFrame) -> Column:
    """The day after the last registration among customers who occur in the log."""
    seen = events.select(F.col("account_id").alias("id")).distinct()
    return profile.join(seen, "id", "left_semi").agg(F.date_add(F.max("registered_on_date"), 1)).scalar()


def tenure_column(events: DataFrame, profile: DataFrame) -> Column:
    return (
        F.date_diff(reference_date(events, profile), F.col("registered_on_date"))
        .cast("double")
        .alias("customer_tenure_days")
    )


def count_names(short: float, long: float) -> tuple[str, str]:
    return f"tx_count_{short:g}d", f"tx_count_{long:g}d"


def history(
    events: DataFrame,
    short: float = 7.0,
    long: float = 28.0,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """What each customer had done strictly before each moment an offer reached them.

    One row per (customer_id, t_received).  A count over the last *d* days is the
    running count at the send minus the running count *d* days earlier, so every
    send drops two marker rows into its customer's timeline.  The cost is one
    sort per customer, whatever the number of earlier events.
    """
    hot = hot_customers(events) if hot is None else hot
    count = lambda kind: F.count_if(F.col("event") == kind)
    spent = F.when(F.col("event") == PURCHASE, F.col("amount"))
    known = events.where(F.col("account_id").isNotNull() & F.col("time_since_test_start").isNotNull()).select(
        F.col("account_id").alias("customer_id"), F.col("time_since_test_start").alias("t"), "event", "amount"
    )
    moments = (
        by_customer(known, hot)
        .groupBy("customer_id", "t")
        .agg(
            count(PURCHASE).alias("tx"),
            F.coalesce(F.sum(spent), F.lit(0.0)).alias("spend"),
            F.count(spent).alias("priced"),
            count(RECEIVED).alias("received"),
            count(VIEWED).alias("viewed"),
            count(COMPLETED).alias("completed"),
        )
    )
    counted = ("tx", "priced", "received", "viewed", "completed")

    def marker(at: Column, role: int) -> Column:
        real = role == 2
        return F.struct(
            at.alias("at"),
            F.lit(role).alias("role"),
            F.col("t").alias("t_received"),
            *[(F.col(c) if real else F.lit(0).cast("bigint")).alias(c) for c in counted],
            (F.col("spend") if real else F.lit(0.0)).alias("spend"),
            (F.col("received") > 0).alias("anchor"),
        )

    event_row = marker(F.col("t"), 2)
    line = moments.select(
        "customer_id",
        F.inline(
            F.when(
                F.col("received") > 0,
                F.array(marker(F.col("t") - short, 0), marker(F.col("t") - long, 1), event_row),
            ).otherwise(F.array(event_row))
        ),
    )
    before = running_in_time(
        line,
        hot,
        ["customer_id"],
        ["at", "role"],
        [
            *[Measure(f"sum_{c}", F.col(c)) for c in (*counted, "spend")],
            Measure("last_tx", F.when(F.col("tx") > 0, F.col("at")), "max"),
            Measure("last_view", F.when(F.col("viewed") > 0, F.col("at")), "max"),
        ],
    ).where("anchor")
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    short_name, long_name = count_names(short, long)
    per_send = before.groupBy("customer_id", "t_received").agg(
        *[at(2, f"sum_{c}").alias(c) for c in (*counted, "spend")],
        at(2, "last_tx").alias("last_tx"),
        at(2, "last_view").alias("last_view"),
        at(0, "sum_tx").alias("tx_until_short"),
        at(1, "sum_tx").alias("tx_until_long"),
    )
    return per_send.select(
        "customer_id",
        "t_received",
        (F.col("tx") - F.col("tx_until_short")).alias(short_name),
        (F.col("tx") - F.col("tx_until_long")).alias(long_name),
        F.col("tx").alias("transaction_count_before"),
        F.col("spend").alias("total_spend_before"),
        F.when(F.col("priced") > 0, F.col("spend") / F.col("priced")).alias("avg_ticket_before"),
        F.col("received").alias("offers_received_count_before"),
        F.col("viewed").alias("offers_viewed_count_before"),
        F.col("completed").alias("offers_completed_count_before"),
        (F.col("t_received") - F.col("last_tx")).alias("days_since_last_tx"),
        (F.col("t_received") - F.col("last_view")).alias("days_since_last_offer_view"),
        ratio(F.col("viewed"), F.col("received")).alias("view_rate_before"),
        ratio(F.col("completed"), F.col("received")).alias("completion_rate_before"),
    )


def history_by_join(events: DataFrame, opps: DataFrame, short: float = 7.0) -> DataFrame:
    """Counts and spend before each send by joining it to all earlier events.

    A check of :func:`history` for small inputs; it pairs sends with events.
    """
    past = events.select(
        F.col("account_id").alias("customer_id"), "event", "amount", F.col("time_since_test_start").alias("t")
    )
    bought = F.col("event") == PURCHASE
    return (
        opps.select("opp_id", "customer_id", "t_received")
        .join(past, "customer_id")
        .where(F.col("t") < F.col("t_received"))
        .groupBy("opp_id")
        .agg(
            F.count_if(bought & (F.col("t") >= F.col("t_received") - short)).alias("tx_count_short"),
            F.count_if(bought).alias("transaction_count_before"),
            F.sum(F.when(bought, F.col("amount"))).alias("total_spend_before"),
            F.count_if(F.col("event") == VIEWED).alias("offers_viewed_count_before"),
        )
    )


def history_columns(short: float = 7.0, long: float = 28.0) -> list[str]:
    return [
        *count_names(short, long),
        "transaction_count_before",
        "total_spend_before",
        "avg_ticket_before",
        "offers_received_count_before",
        "offers_viewed_count_before",
        "offers_completed_count_before",
        "days_since_last_tx",
        "days_since_last_offer_view",
        "view_rate_before",
        "completion_rate_before",
    ]


def fill_defaults(df: DataFrame, short: float = 7.0, long: float = 28.0, accuracy: int = 10_000) -> DataFrame:
    """Leave no numeric feature null.

    No history counts as zero, a time since an event that never happened as
    ``NEVER_DAYS``; profile gaps take the median of the known values, found by a
    fixed-size sketch and attached as a scalar.
    """
    imputed = ("customer_age", "customer_credit_limit", "customer_tenure_days")
    medians = df.agg(
        F.struct(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in imputed]).alias("m")
    ).scalar()
    # one column with the scalar row, so that the plan holds the subquery once
    with_medians = df.select("*", medians.alias("__medians"))
    fills = {c: F.lit(0.0) for c in history_columns(short, long)}
    fills |= {c: F.lit(NEVER_DAYS) for c in ("days_since_last_tx", "days_since_last_offer_view")}
    filled = []
    for c in df.columns:
        if c in imputed:
            filled.append(F.coalesce(F.col(c), F.col(f"__medians.{c}"), F.lit(0.0)).alias(c))
        elif c in fills:
            filled.append(F.coalesce(F.col(c).cast("double"), fills[c]).alias(c))
        else:
            filled.append(F.col(c))
    return with_medians.select(*filled)


def context_features(
    opps: DataFrame,
    events: DataFrame,
    profile: DataFrame,
    short: float = 7.0,
    long: float = 28.0,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """The context table: keys, outcome, and features known when the offer was sent.

    Everything that comes from the opportunity's own row is one projection; only
    the history is joined, on the pair it is keyed by.
    """
    past = history(events, short, long, hot)
    known = opps.select(
        *base_columns(),
        *offer_columns(),
        *channel_columns(),
        *profile_columns(),
        tenure_column(events, profile),
    )
    joined = known.join(past, ["customer_id", "t_received"], "left")
    ordered = [*known.columns[:-1], *history_columns(short, long), "customer_tenure_days"]
    return fill_defaults(joined.select(*ordered), short, long)


def feature_columns(contexts: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical features, without keys, outcomes and offer properties.

    The properties of the offer that was sent name that offer, so a model per
    offer must not see them.
    """
    left_out = {*KEY_COLUMNS, *OUTCOME_COLUMNS, *OFFER_COLUMNS}
    fields = [f for f in contexts.schema.fields if f.name not in left_out]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    categorical = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    return numeric, categorical


def standardize(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """z-scores with the population deviation; a constant column only loses its mean.

    ``fit_on`` takes the statistics from other rows, for example the first round.
    """
    stats = (df if fit_on is None else fit_on).agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    stat = lambda name: F.col(f"__stats.{name}")
    scaled = {
        c: (F.col(c) - stat(f"mean_{c}")) / F.coalesce(F.nullif(stat(f"sd_{c}"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    }
    with_stats = df.select("*", stats.alias("__stats"))
    return with_stats.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


#: Rounds whose statistics are merged on the driver.
MAX_ROUNDS = 10_000


def standardize_prefix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` scaled by the mean and population deviation of all earlier rounds.

    Spark adds up count, mean and squared deviation per round; these few numbers are merged round
    by round and sent back with the round they hold for.  A row never depends on its own round
    or a later one.  The first round has nothing earlier and is left unscaled; a column without
    spread so far has deviation 1.
    """
    per_round = df.groupBy("round_day").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.var_pop(c) for c in columns]).alias("var"),
    )
    rounds = per_round.where("round_day IS NOT NULL").limit(MAX_ROUNDS + 1).collect()
    if len(rounds) > MAX_ROUNDS:
        raise ValueError(f"more than {MAX_ROUNDS} rounds; cut the log into slices of time first")
    n, mean, squares = 0, [0.0] * len(columns), [0.0] * len(columns)
    scales = []
    for row in sorted(rounds, key=lambda r: r["round_day"]):
        if n:
            scales.append((row["round_day"], mean, [sd if (sd := (q / n) ** 0.5) > 1e-9 else 1.0 for q in squares]))
        gaps = [b - a for a, b in zip(mean, row["mean"])]
        total = n + row["n"]
        squares = [q + v * row["n"] + g * g * n * row["n"] / total for q, v, g in zip(squares, row["var"], gaps)]
        mean, n = [a + g * row["n"] / total for a, g in zip(mean, gaps)], total
    known = df.sparkSession.createDataFrame(scales, "round_day int, __mean array<double>, __sd array<double>")
    own = df.join(F.broadcast(known), "round_day", "left")
    scaled = [
        ((F.col(c) - F.coalesce(F.col("__mean")[i], F.lit(0.0))) / F.coalesce(F.col("__sd")[i], F.lit(1.0))).alias(c)
        for i, c in enumerate(columns)
    ]
    return own.select(*[c for c in df.columns if c not in columns], *scaled)


def one_hot(column: str, levels: Sequence[str], prefix: str) -> list[Column]:
    return [
        F.coalesce(F.col(column) == level, F.lit(False)).cast("double").alias(f"{prefix}_{level}")
        for level in levels
    ]


def design_names(contexts: DataFrame) -> list[str]:
    numeric, _ = feature_columns(contexts)
    return ["bias", *numeric, *[f"gender_{g}" for g in GENDERS]]


def design_matrix(
    contexts: DataFrame, fit_on: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Keys, reward and the feature vector ``x``: bias, z-scores, gender indicators.

    Columns named in ``keep`` come along unscaled, as ``raw_<name>``.
    """
    numeric, _ = feature_columns(contexts)
    raw = [F.col(c).alias(f"raw_{c}") for c in keep]
    scaled = standardize(contexts.select("*", *raw), numeric, fit_on)
    return scaled.select(
        *KEY_COLUMNS,
        F.col("reward").cast("int").alias("reward"),
        F.array(
            F.lit(1.0),
            *[F.col(c).cast("double") for c in numeric],
            *one_hot("customer_gender", GENDERS, "gender"),
        ).alias("x"),
        *[f"raw_{c}" for c in keep],
    )
