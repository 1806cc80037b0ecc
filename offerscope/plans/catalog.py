"""Every named query: (session, folder of the test tables) to a DataFrame.

Outputs are made comparable across engines: doubles to six places, arrays and
dates as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.functions.columns import AGE_BANDS, COMPLETABLE_TYPES, age_band
from offerscope.operators import attribution, features, metrics, policies, posterior, quality
from offerscope.operators.posterior import arms_frame, collect_arms, prior_arms
from offerscope.plans.campaign import Campaign
from offerscope.session import new_staging_path, release_staged, staging_root, tune
from offerscope.sources import files, fixtures
from offerscope.sources.files import verified_write
from offerscope.streaming import attribution as stream_ops
from offerscope.streaming import files as stream_files
from offerscope.streaming import posterior as online

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Callable[[Campaign], DataFrame]] = {}

COVARIATES = ("age", "credit_card_limit")


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(build: Callable[[Campaign], DataFrame]) -> Callable[[Campaign], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def run(name: str, campaign: Campaign) -> DataFrame:
    """One query on a campaign, which several queries may share."""
    return comparable(_QUERIES[name](campaign))


_SHARED: dict[tuple, Campaign] = {}


def shared_campaign(spark: SparkSession, sf_dir: str) -> Campaign:
    """One campaign for all queries of a session on a folder, as long as its input files stay the same."""
    key = (spark.sparkContext.applicationId, staging_root(spark), sf_dir, fixtures.input_state(spark, sf_dir))
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[:3] == key[:3] or k[0] != key[0]]:
            del _SHARED[old]
        _SHARED[key] = Campaign.from_parquet(spark, sf_dir)
    tune(spark)
    return _SHARED[key]


def release(spark: SparkSession) -> int:
    """Forget the shared campaigns and delete what they staged."""
    _SHARED.clear()
    return release_staged(spark)


def queries() -> dict[str, Query]:
    def bind(name: str) -> Query:
        return lambda spark, sf_dir: run(name, shared_campaign(spark, sf_dir))

    return {name: bind(name) for name in _QUERIES}


# -- tables -----------------------------------------------------------------------------


@query
def sink_roundtrip(c: Campaign) -> DataFrame:
    path = new_staging_path(c.offers.sparkSession, "opportunities")
    stored = verified_write(c.opps, path)
    return stored.agg(
        F.count(F.lit(1)).alias("n_stored"),
        F.count_distinct("round_day").alias("n_rounds"),
        F.sum("completed").alias("n_completed"),
    )


@query
def json_roundtrip(c: Campaign) -> DataFrame:
    """The raw tables written as JSON and read again with the declared schemas."""
    folder = new_staging_path(c.offers.sparkSession, "json")
    files.write_raw(c.raw, folder)
    back = Campaign(files.read_raw(c.offers.sparkSession, folder))
    counts = [
        back.offers.agg(F.lit("offers").alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum("discount_value").alias("total")),
        back.profile.agg(F.lit("profile").alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum("credit_card_limit").alias("total")),
        back.events.agg(F.lit("transactions").alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def json_quarantine(c: Campaign) -> DataFrame:
    """Raw events as JSON lines, those of one customer in fifty cut short: what parses, and what is set aside."""
    spark = c.offers.sparkSession
    folder, aside = (new_staging_path(spark, n) for n in ("json", "quarantine"))
    raw = c.raw.transactions
    line = F.to_json(F.struct(*raw.columns))
    damaged = F.col("account_id").cast("bigint") % 50 == 0
    cut = F.when(damaged, F.expr("substr(line, 1, length(line) - 7)")).otherwise(F.col("line"))
    raw.select(line.alias("line"), "account_id").select(cut.alias("value")).write.text(folder)
    good, bad = files.read_quarantined(spark, folder, raw.schema, aside)
    n_bad = bad.agg(F.count(F.lit(1))).scalar()
    return good.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value.amount").alias("amount"), F.max(n_bad).alias("n_set_aside")
    )


@query
def sink_incremental(c: Campaign) -> DataFrame:
    """The opportunity table stored after 16 days, then brought up to date with the rest of the log."""
    path = new_staging_path(c.offers.sparkSession, "opportunities")
    build = lambda events: attribution.opportunities(events, c.offers, c.profile, c.hot)
    since = 16.0
    files.write_opportunities(build(c.staged_events.where(F.col("time_since_test_start") < since)), path)
    files.update_opportunities(path, c.staged_events, since, build)
    return files.read_opportunities(c.offers.sparkSession, path).groupBy("round_day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("viewed").alias("viewed"),
        F.sum("completed").alias("completed"),
        F.sum("informational_success").alias("informational_success"),
        F.sum("t_viewed").alias("view_times"),
    )


@query
def profile_clean(c: Campaign) -> DataFrame:
    return c.profile


@query
def transactions_flat(c: Campaign) -> DataFrame:
    return c.events


@query
def age_bands(c: Campaign) -> DataFrame:
    return c.profile.select("id", "age", age_band(F.col("age")).alias("age_group"))


@query
def event_log(c: Campaign) -> DataFrame:
    return c.log


@query
def opportunities(c: Campaign) -> DataFrame:
    return c.opps


@query
def opportunities_latest_send(c: Campaign) -> DataFrame:
    """The opportunity table with every view and completion given to one send."""
    found = attribution.opportunities(c.staged_events, c.offers, c.profile, c.hot, attribution.LATEST_SEND)
    return found.select(
        "opp_id", "customer_id", "offer_id", "t_received", "t_viewed", "t_completed", "viewed", "completed", "informational_success"
    )


@query
def overcount_latest_send(c: Campaign) -> DataFrame:
    found = attribution.opportunities(c.staged_events, c.offers, c.profile, c.hot, attribution.LATEST_SEND)
    return quality.completion_overcount(c.staged_events, found)


@query
def informational_success(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", "offer_type", "t_viewed", "t_expires", "informational_success")


@query
def reward_label(c: Campaign) -> DataFrame:
    return c.opps.select(*features.base_columns())


# -- customers, offers, log ---------------------------------------------------------------


@query
def profile_by_gender(c: Campaign) -> DataFrame:
    return metrics.profile_by_gender(c.profile)


@query
def offers_by_channel(c: Campaign) -> DataFrame:
    return metrics.offers_by_channel(c.offers)


@query
def limit_by_age(c: Campaign) -> DataFrame:
    return metrics.limit_by_age(c.profile)


@query
def events_by_type(c: Campaign) -> DataFrame:
    return metrics.events_by_type(c.events)


@query
def sends_by_round(c: Campaign) -> DataFrame:
    return metrics.sends_by_round(c.opps)


@query
def weekly_events(c: Campaign) -> DataFrame:
    return metrics.weekly_events(c.events)


# -- funnel and segments --------------------------------------------------------------------


@query
def funnel_by_type(c: Campaign) -> DataFrame:
    return metrics.funnel_by_type(c.opps)


@query
def funnel_by_offer(c: Campaign) -> DataFrame:
    return metrics.funnel_by_offer(c.opps)


@query
def organic_share(c: Campaign) -> DataFrame:
    return metrics.organic_share(c.opps)


@query
def organic_by_segment(c: Campaign) -> DataFrame:
    return metrics.organic_by_segment(c.opps)


@query
def completion_by_duration(c: Campaign) -> DataFrame:
    return metrics.completion_by_duration(c.opps)


@query
def completion_by_channel(c: Campaign) -> DataFrame:
    return metrics.completion_by_channel(c.opps)


@query
def completion_channel_pivot(c: Campaign) -> DataFrame:
    return metrics.completion_channel_pivot(c.opps, [*COMPLETABLE_TYPES, "informational"])


@query
def spend_by_user_group(c: Campaign) -> DataFrame:
    return metrics.spend_by_user_group(c.staged_events, c.opps)


@query
def spend_ratios(c: Campaign) -> DataFrame:
    return metrics.spend_ratios(metrics.spend_by_user_group(c.staged_events, c.opps))


@query
def completion_by_cohort(c: Campaign) -> DataFrame:
    return metrics.completion_by_cohort(c.opps)


@query
def completion_gender_age(c: Campaign) -> DataFrame:
    return metrics.completion_gender_age(c.opps)


@query
def completion_heat_table(c: Campaign) -> DataFrame:
    table = metrics.completion_heat_table(c.opps)
    names = {b: "age_" + b.lower().replace("-", "_").replace("+", "_up") for b in AGE_BANDS}
    return table.withColumnsRenamed(names)


@query
def converter_profile(c: Campaign) -> DataFrame:
    return metrics.converter_profile(c.opps)


@query
def repeat_groups(c: Campaign) -> DataFrame:
    return metrics.repeat_groups(c.opps)


@query
def send_rank(c: Campaign) -> DataFrame:
    ranked = metrics.send_rank(c.opps, c.hot)
    return ranked.select("opp_id", "customer_id", "offer_id", "t_received", "instance_rank")


@query
def first_vs_repeat(c: Campaign) -> DataFrame:
    return metrics.first_vs_repeat(c.opps, c.hot)


@query
def informational_outcomes(c: Campaign) -> DataFrame:
    return metrics.informational_outcomes(c.opps)


@query
def completer_ticket(c: Campaign) -> DataFrame:
    return metrics.completer_ticket(c.staged_events, c.opps)


# -- quality -----------------------------------------------------------------------------------


@query
def null_profile(c: Campaign) -> DataFrame:
    return quality.null_profile(
        {
            "offers": (c.offers, ("id", "offer_type", "duration", "channels")),
            "profile": (c.raw.profile, ("id", "gender", "age", "credit_card_limit")),
            "transactions": (c.raw.transactions, ("account_id", "event", "time_since_test_start", "value")),
        }
    )


@query
def incomplete_share(c: Campaign) -> DataFrame:
    return quality.incomplete_share(c.profile)


@query
def row_conservation(c: Campaign) -> DataFrame:
    return quality.row_conservation(c.events, c.log, c.opps)


@query
def key_uniqueness(c: Campaign) -> DataFrame:
    return quality.key_uniqueness(c.opps, "opp_id")


@query
def reward_matches_discount(c: Campaign) -> DataFrame:
    return quality.reward_matches_discount(c.log)


@query
def completion_overcount(c: Campaign) -> DataFrame:
    return quality.completion_overcount(c.staged_events, c.opps)


@query
def round_check(c: Campaign) -> DataFrame:
    return quality.round_check(c.opps)


@query
def context_nulls(c: Campaign) -> DataFrame:
    numeric, categorical = features.feature_columns(c.contexts)
    return quality.null_counts(c.contexts, [*numeric, *categorical])


@query
def numeric_summary(c: Campaign) -> DataFrame:
    return quality.numeric_summary(c.profile, COVARIATES)


@query
def assignment_balance(c: Campaign) -> DataFrame:
    return quality.assignment_balance(c.opps, COVARIATES)


@query
def histogram_age(c: Campaign) -> DataFrame:
    return quality.histogram(c.profile, "age")


@query
def histogram_limit(c: Campaign) -> DataFrame:
    return quality.histogram(c.profile, "credit_card_limit")


@query
def feature_correlation(c: Campaign) -> DataFrame:
    numeric, _ = features.feature_columns(c.staged_contexts)
    return quality.correlation(c.staged_contexts, numeric)


@query
def feature_quartiles(c: Campaign) -> DataFrame:
    shown = ["customer_tenure_days", "avg_ticket_before", "completion_rate_before", "customer_age"]
    return quality.feature_quartiles(c.staged_contexts, shown)


# -- features --------------------------------------------------------------------------------------


@query
def offer_features(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", *features.offer_columns())


@query
def channel_features(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", *features.channel_columns())


@query
def profile_features(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", *features.profile_columns())


@query
def history_features(c: Campaign) -> DataFrame:
    past = features.history(c.staged_events, hot=c.hot)
    return c.opps.select("opp_id", "customer_id", "t_received").join(past, ["customer_id", "t_received"], "left")


@query
def tenure_features(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", features.tenure_column(c.staged_events, c.profile))


@query
def context_features(c: Campaign) -> DataFrame:
    return c.contexts


@query
def standardized(c: Campaign) -> DataFrame:
    numeric, _ = features.feature_columns(c.staged_contexts)
    return features.standardize(c.staged_contexts.select("opp_id", *numeric), numeric)


@query
def standardized_prefix(c: Campaign) -> DataFrame:
    numeric, _ = features.feature_columns(c.staged_contexts)
    return features.standardize_prefix(c.staged_contexts.select("opp_id", "round_day", *numeric), numeric)


@query
def gender_onehot(c: Campaign) -> DataFrame:
    return c.opps.select("opp_id", *features.profile_columns()).select(
        "opp_id", *features.one_hot("customer_gender", features.GENDERS, "gender")
    )


@query
def design_matrix(c: Campaign) -> DataFrame:
    wide = [F.col("x")[i].alias(name) for i, name in enumerate(c.feature_names)]
    return features.design_matrix(c.staged_contexts).select("opp_id", "offer_id", "round_day", "reward", *wide)


@query
def arm_distribution(c: Campaign) -> DataFrame:
    return metrics.arm_distribution(c.contexts)


@query
def best_offer(c: Campaign) -> DataFrame:
    return metrics.best_offer(c.contexts)


@query
def most_recent_active(c: Campaign) -> DataFrame:
    return metrics.most_recent_active(c.contexts).select("opp_id", "customer_id", "days_since_last_tx")


# -- policies ------------------------------------------------------------------------------------------


@query
def arm_values(c: Campaign) -> DataFrame:
    return c.arm_values


@query
def arm_posterior_step(c: Campaign) -> DataFrame:
    pairs = c.arms_table.select("offer_id", F.posexplode(F.arrays_zip("m", "q")).alias("position", "pair"))
    return pairs.select("offer_id", "position", "pair.m", "pair.q")


@query
def map_scores(c: Campaign) -> DataFrame:
    scored = c.design.select("opp_id", policies.map_scores(c.arms).alias("__scores"))
    return scored.select("opp_id", F.inline("__scores")).drop("tie")


@query
def thompson_choice(c: Campaign) -> DataFrame:
    chosen = policies.score_table(c.design, policies.thompson_scores(c.arms))
    return chosen.select("opp_id", "chosen_offer", "chosen_p", "chosen_score")


@query
def replay_eval(c: Campaign) -> DataFrame:
    fixed = {
        "random": policies.random_offer(list(c.values)),
        "fixed": F.lit(c.best_by_rate),
        "logged": F.col("offer_id"),
    }
    return policies.replay(c.design, fixed)


@query
def replay_running(c: Campaign) -> DataFrame:
    fixed = {"random": policies.random_offer(list(c.values)), "fixed": F.lit(c.best_by_rate)}
    return policies.replay_running(c.design, fixed)


@query
def policy_summary(c: Campaign) -> DataFrame:
    return policies.replay(c.design, c.policies())


@query
def best_offer_by_value(c: Campaign) -> DataFrame:
    return policies.best_offer_by_value(c.design, policies.map_scores(c.response_models))


@query
def recommend(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.trained_arms))


@query
def top3_offers(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.trained_arms), top=3)


@query
def recommended_share(c: Campaign) -> DataFrame:
    return policies.recommended_share(c.design, policies.map_scores(c.trained_arms))


@query
def policy_regret(c: Campaign) -> DataFrame:
    return policies.policy_regret(
        c.design, policies.map_scores(c.trained_arms), {**c.policies(), "logged": F.col("offer_id")}
    )


@query
def historic_value(c: Campaign) -> DataFrame:
    return policies.historic_value(c.design)


@query
def value_projection(c: Campaign) -> DataFrame:
    return policies.value_projection(c.design, policies.replay(c.design, c.policies()))


@query
def top_weights(c: Campaign) -> DataFrame:
    return policies.top_weights(c.trained_table, c.feature_names)


@query
def weight_table(c: Campaign) -> DataFrame:
    return policies.weight_pivot(c.trained_table, c.feature_names, list(c.values))


@query
def example_customers(c: Campaign) -> DataFrame:
    return policies.example_customers(c.design, policies.map_scores(c.trained_arms), c.offer_types)


# -- the same formulas with closed-form arms, which SQL can compute too ------------------------------------


@query
def step_replay(c: Campaign) -> DataFrame:
    return policies.replay(c.design, c.step_policies())


@query
def step_best_offer(c: Campaign) -> DataFrame:
    return policies.best_offer_by_value(c.design, policies.map_scores(c.arms))


@query
def step_ranking(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.arms))


@query
def step_top3(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.arms), top=3)


@query
def step_share(c: Campaign) -> DataFrame:
    return policies.recommended_share(c.design, policies.map_scores(c.arms))


@query
def step_regret(c: Campaign) -> DataFrame:
    scores = policies.map_scores(c.arms)
    return policies.policy_regret(c.design, scores, {**c.step_policies(), "logged": F.col("offer_id")})


@query
def step_projection(c: Campaign) -> DataFrame:
    return policies.value_projection(c.design, policies.replay(c.design, c.step_policies()))


@query
def step_top_weights(c: Campaign) -> DataFrame:
    return policies.top_weights(c.arms_table, c.feature_names)


@query
def step_weights(c: Campaign) -> DataFrame:
    return policies.weight_pivot(c.arms_table, c.feature_names, list(c.values))


@query
def step_examples(c: Campaign) -> DataFrame:
    return policies.example_customers(c.design, policies.map_scores(c.arms), c.offer_types)


# -- learning by diagonal steps, which chained SQL can compute too -------------------------------------------


@query
def diagonal_posterior(c: Campaign) -> DataFrame:
    pairs = c.diagonal_table.select("offer_id", F.posexplode(F.arrays_zip("m", "q")).alias("position", "pair"))
    return pairs.select("offer_id", "position", "pair.m", "pair.q")


@query
def diagonal_replay(c: Campaign) -> DataFrame:
    return policies.learning_summary(c.diagonal[0], c.design)


@query
def diagonal_rounds(c: Campaign) -> DataFrame:
    return policies.learning_curve(c.diagonal[0])


@query
def diagonal_sweep(c: Campaign) -> DataFrame:
    by_round, _ = policies.thompson_replay(
        c.design, c.values, c.n_features, policies.PRIOR_PRECISIONS, update=posterior.diagonal_update
    )
    return policies.learning_summary(by_round, c.design)


@query
def diagonal_summary(c: Campaign) -> DataFrame:
    return policies.replay(c.design, c.policies(diagonal=True))


@query
def diagonal_best_offer(c: Campaign) -> DataFrame:
    return policies.best_offer_by_value(c.design, policies.map_scores(c.diagonal_arms))


@query
def diagonal_recommend(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.diagonal_arms))


@query
def diagonal_top3(c: Campaign) -> DataFrame:
    return policies.recommend(c.design, policies.map_scores(c.diagonal_arms), top=3)


@query
def diagonal_share(c: Campaign) -> DataFrame:
    return policies.recommended_share(c.design, policies.map_scores(c.diagonal_arms))


@query
def diagonal_regret(c: Campaign) -> DataFrame:
    scores = policies.map_scores(c.diagonal_arms)
    return policies.policy_regret(c.design, scores, {**c.policies(diagonal=True), "logged": F.col("offer_id")})


@query
def diagonal_projection(c: Campaign) -> DataFrame:
    return policies.value_projection(c.design, policies.replay(c.design, c.policies(diagonal=True)))


@query
def diagonal_top_weights(c: Campaign) -> DataFrame:
    return policies.top_weights(c.diagonal_table, c.feature_names)


@query
def diagonal_weights(c: Campaign) -> DataFrame:
    return policies.weight_pivot(c.diagonal_table, c.feature_names, list(c.values))


@query
def diagonal_examples(c: Campaign) -> DataFrame:
    return policies.example_customers(c.design, policies.map_scores(c.diagonal_arms), c.offer_types)


# -- learning policies and response models ----------------------------------------------------------------


@query
def arm_posterior(c: Campaign) -> DataFrame:
    return policies.weight_table(c.trained_table, c.feature_names)


@query
def replay_thompson(c: Campaign) -> DataFrame:
    return policies.learning_summary(c.learning[0], c.design)


@query
def replay_thompson_rounds(c: Campaign) -> DataFrame:
    return policies.learning_curve(c.learning[0])


@query
def prior_sweep(c: Campaign) -> DataFrame:
    by_round, _ = policies.thompson_replay(c.design, c.values, c.n_features, policies.PRIOR_PRECISIONS)
    return policies.learning_summary(by_round, c.design)


@query
def calibration(c: Campaign) -> DataFrame:
    return policies.calibration(c.design, c.response_models)


@query
def response_optimality(c: Campaign) -> DataFrame:
    return policies.optimality(c.design, c.response_models, c.feature_names)


@query
def calibration_deciles(c: Campaign) -> DataFrame:
    return policies.calibration_deciles(c.design, c.response_models)


@query
def calibration_heldout(c: Campaign) -> DataFrame:
    """By offer and decile, on rounds that the models were not fitted on."""
    return policies.by_decile(policies.heldout_scores(c.design, c.heldout_models))


@query
def heldout_optimality(c: Campaign) -> DataFrame:
    return policies.heldout_optimality(c.design, c.heldout_models, c.feature_names)


@query
def response_regret(c: Campaign) -> DataFrame:
    return policies.policy_regret(c.design, policies.map_scores(c.response_models), c.policies())


# -- streams --------------------------------------------------------------------------------------------------


def _online(c: Campaign, update_rule) -> list:
    """The arms after a posterior was updated as each round's outcomes arrived."""
    spark = c.offers.sparkSession
    source, table, progress = (new_staging_path(spark, n) for n in ("outcomes", "posterior", "progress"))
    outcomes = c.design.select("offer_id", "x", "reward", "round_day")
    prior = prior_arms(c.values, c.n_features)
    days = posterior.time_slices(outcomes)
    for low, high in days:
        outcomes.where(posterior.in_slice("round_day", low, high)).write.mode("append").parquet(source)
        stream = stream_files.event_stream(spark, source, outcomes.schema, files_per_batch=1_000_000)
        online.run_updates(stream, table, progress, prior, update_rule)
    return collect_arms(spark.read.parquet(online.version_path(table, len(days) - 1))) if days else prior


@query
def online_posterior(c: Campaign) -> DataFrame:
    """The weights of the last version of a posterior on a stream of outcomes."""
    return policies.weight_table(arms_frame(c.offers.sparkSession, _online(c, posterior.update_arms)), c.feature_names)


@query
def diagonal_online(c: Campaign) -> DataFrame:
    """The same by diagonal steps."""
    arms = _online(c, posterior.diagonal_update)
    return policies.weight_table(arms_frame(c.offers.sparkSession, arms), c.feature_names)


@query
def stream_attribution(c: Campaign) -> DataFrame:
    """The event log replayed as a stream of files, attributed as it arrives."""
    spark = c.offers.sparkSession
    source, output, checkpoint = (new_staging_path(spark, n) for n in ("stream", "attributed", "progress"))
    stream_files.write_log(c.events, "time_since_test_start", source)
    events = stream_files.event_stream(spark, source, c.events.schema, files_per_batch=2)
    partitions = stream_files.state_partitions(spark, source)
    stream_files.run_to_files(stream_ops.attribute_stream(events, c.offers), output, checkpoint, partitions)
    return stream_ops.latest(spark.read.parquet(output))


@query
def stream_labels(c: Campaign) -> DataFrame:
    """The success label of every send, from the event log replayed as a stream of files."""
    spark = c.offers.sparkSession
    source, output, checkpoint = (new_staging_path(spark, n) for n in ("stream", "labels", "progress"))
    stream_files.write_log(c.events, "time_since_test_start", source)
    # closes the windows that are open at the log's end; the operators in a row each need a batch
    for _ in range(2):
        stream_ops.heartbeat(c.events, c.offers, delay_days=30).write.mode("append").parquet(source)
    events = stream_files.event_stream(spark, source, c.events.schema, files_per_batch=2)
    partitions = stream_files.state_partitions(spark, source)
    stream_files.run_to_files(stream_ops.label_stream(events, c.offers, "30 days"), output, checkpoint, partitions)
    return spark.read.schema("opp_id string, customer_id string, offer_id string, t_received double, reward int").parquet(output)
