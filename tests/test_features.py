import math
import random

import pytest
import small
from pyspark.sql import functions as F
from small import done, paid, seen, sent

from offerscope.operators import attribution, cleaning, features, quality
from offerscope.operators.quantiles import exact_quantiles
from offerscope.operators.timeline import hot_keys


def tables(spark, rows):
    events = cleaning.flatten_transactions(small.transactions(spark, rows))
    profile = cleaning.clean_profile(small.profile(spark))
    return attribution.opportunities(events, small.offers(spark), profile), events, profile


def test_history_is_strictly_before_and_lookback_inclusive(spark):
    rows = [
        paid("c1", 2.9, 4.0), paid("c1", 3.0, 5.0), paid("c1", 9.0, None), paid("c1", 10.0, 99.0),
        sent("c1", "d", 1.0), seen("c1", "d", 2.0), sent("c1", "b", 10.0), done("c1", "b", 10.0),
    ]
    opps, events, _ = tables(spark, rows)
    row = features.history(events).where("t_received = 10").first()
    assert row["tx_count_7d"] == 2 and row["tx_count_28d"] == 3 and row["transaction_count_before"] == 3
    assert row["total_spend_before"] == 9.0 and row["avg_ticket_before"] == 4.5
    assert (row["offers_received_count_before"], row["offers_viewed_count_before"]) == (1, 1)
    assert row["offers_completed_count_before"] == 0
    assert (row["days_since_last_tx"], row["days_since_last_offer_view"]) == (1.0, 8.0)
    assert row["view_rate_before"] == 1.0


def test_first_day_send_has_no_history(spark):
    opps, events, profile = tables(spark, [sent("c1", "b", 0.0), paid("c1", 1.0)])
    row = features.context_features(opps, events, profile).first()
    assert row["transaction_count_before"] == 0 and row["days_since_last_tx"] == 30.0
    assert row["avg_ticket_before"] == 0.0 and row["view_rate_before"] == 0.0


def test_later_events_change_nothing(spark):
    past = [sent("c1", "b", 5.0), paid("c1", 1.0, 3.0), seen("c1", "b", 4.0)]
    later = [paid("c1", 5.0, 50.0), paid("c1", 6.0, 50.0), seen("c1", "b", 5.0), sent("c1", "d", 8.0)]
    known = lambda rows: small.rows(features.history(tables(spark, rows)[1]).where("t_received = 5"))
    assert known(past) == known(past + later)


def test_names_follow_the_lookbacks(spark):
    opps, events, _ = tables(spark, [sent("c1", "b", 5.0), paid("c1", 3.5)])
    row = features.history(events, 1.0, 2.0).first()
    assert (row["tx_count_1d"], row["tx_count_2d"]) == (0, 1)


def test_sort_form_equals_join_form(campaign):
    wanted = ["opp_id", "tx_count_short", "transaction_count_before", "total_spend_before", "offers_viewed_count_before"]
    joined = {r["opp_id"]: r for r in features.history_by_join(campaign.events, campaign.opps).select(wanted).collect()}
    for row in campaign.staged_contexts.collect():
        past = joined.get(row["opp_id"])
        assert row["transaction_count_before"] == (past["transaction_count_before"] if past else 0)
        assert row["tx_count_7d"] == (past["tx_count_short"] if past else 0)
        assert row["offers_viewed_count_before"] == (past["offers_viewed_count_before"] if past else 0)
        spend = (past["total_spend_before"] if past else 0) or 0
        assert math.isclose(row["total_spend_before"], spend, abs_tol=1e-6)


def test_cutting_hot_customers_changes_nothing(campaign):
    everybody = hot_keys(campaign.events, F.col("account_id"), 1)
    rounded = lambda df: small.rows(
        df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    )
    assert rounded(features.history(campaign.events, hot=everybody)) == rounded(features.history(campaign.events, hot=[]))


def test_tenure_reference_is_the_last_registration_in_the_log(spark):
    opps, events, profile = tables(spark, [sent("c1", "b", 0.0), sent("c3", "b", 0.0), paid("c1", 1.0)])
    found = opps.select("customer_id", features.tenure_column(events, profile))
    assert dict(small.rows(found)) == {"c1": 1.0, "c3": None}


def test_all_null_profile_still_leaves_no_null(spark):
    opps, events, profile = tables(spark, [sent("c2", "b", 0.0)])
    contexts = features.context_features(opps, events, profile)
    numeric, _ = features.feature_columns(contexts)
    quality.require_no_nulls(contexts, numeric)
    assert contexts.first()["customer_age"] == 0.0


def test_null_check_fails(spark):
    with pytest.raises(ValueError, match="b"):
        quality.require_no_nulls(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"])


def test_column_lists(spark, campaign):
    numeric, categorical = features.feature_columns(campaign.contexts)
    assert len(numeric) == 16 and categorical == ["customer_gender"]
    odd = spark.createDataFrame([], "opp_id string, a decimal(10,2), b smallint, c tinyint, d boolean, reward int")
    assert features.feature_columns(odd) == (["a", "b", "c"], ["d"])


def test_design_rows(campaign):
    rows = campaign.design.select("x").collect()
    columns = list(zip(*[r["x"] for r in rows]))
    assert len(columns) == campaign.n_features == 21
    assert set(columns[0]) == {1.0} and {sum(r["x"][17:]) for r in rows} == {1.0}
    for z in columns[1:17]:
        mean = sum(z) / len(z)
        sd = math.sqrt(sum((v - mean) ** 2 for v in z) / len(z))
        assert abs(mean) < 1e-9 and (abs(sd - 1) < 1e-9 or sd < 1e-9)


def test_scaler_can_be_fitted_on_the_first_round(campaign):
    contexts = campaign.staged_contexts.select("round_day", "customer_age")
    first = contexts.where("round_day = 0")
    scaled = features.standardize(contexts, ["customer_age"], fit_on=first)
    assert abs(scaled.where("round_day = 0").agg(F.avg("customer_age")).first()[0]) < 1e-9


def test_prefix_scaling_ignores_the_own_and_later_rounds(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(d, float(rng.randrange(50)), 7.0) for d in (0, 3, 3, 9) for _ in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(99, None, 1.0, 7.0)], "id int, round_day int, a double, b double")
    found = {r["id"]: r for r in features.standardize_prefix(df, ["a", "b"]).collect()}
    for i, (d, a, _) in enumerate(rows):
        before = [x for e, x, _ in rows if e < d]
        expected = (a - np.mean(before)) / np.std(before) if before else a
        assert math.isclose(found[i]["a"], expected, abs_tol=1e-9)
        assert found[i]["b"] == (0.0 if before else 7.0)


def test_quantiles_put_few_values_in_order(spark):
    df = spark.range(200_000).select((F.col("id") * 0.5).alias("v"))
    row = exact_quantiles(df, ["v"], {"m": 0.5, "t": 0.9}, few=500)
    assert row.first()["m"] == 199_999 / 2 * 0.5 and math.isclose(row.first()["t"], 0.9 * 199_999 * 0.5)


@pytest.mark.parametrize(("accuracy", "few"), [(10_000, 100_000), (50, 20), (20, 1)])
def test_exact_quantiles(spark, accuracy, few):
    rng = random.Random(3)
    values = [float(rng.choice([1, 1, 1, 2, 5, rng.random() * 9])) for _ in range(501)] + [1.0] * 250
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = exact_quantiles(df, ["v"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.93, "e": 1.0}, accuracy=accuracy, few=few).first()
    import numpy as np

    assert row["n"] == len(values)
    for name, p in (("a", 0.0), ("b", 0.25), ("c", 0.5), ("d", 0.93), ("e", 1.0)):
        assert math.isclose(row[name], np.quantile(values, p), abs_tol=1e-12)
