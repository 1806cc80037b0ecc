import random

import small
from pyspark.sql import functions as F
from small import done, paid, seen, sent

from offerscope.operators import attribution, cleaning, features, metrics, quality
from offerscope.operators.timeline import Measure, hot_keys, running


def build(spark, rows, hot=()):
    events = cleaning.flatten_transactions(small.transactions(spark, rows))
    return attribution.opportunities(events, small.offers(spark), cleaning.clean_profile(small.profile(spark)), hot)


def outcome(opps, **where):
    for column, value in where.items():
        opps = opps.where(F.col(column).eqNullSafe(value))
    (row,) = opps.collect()
    return row


def test_window_is_closed_at_both_ends(spark):
    opps = build(
        spark, [sent("c1", "b", 1.0), seen("c1", "b", 1.0), done("c1", "b", 6.0), sent("c2", "b", 1.0), seen("c2", "b", 6.000001)]
    )
    at_ends = outcome(opps, customer_id="c1")
    assert (at_ends["t_viewed"], at_ends["t_completed"], at_ends["t_expires"]) == (1.0, 6.0, 6.0)
    assert outcome(opps, customer_id="c2")["viewed"] == 0


def test_first_outcome_wins_and_earlier_ones_do_not_count(spark):
    opps = build(spark, [seen("c1", "b", 0.5), sent("c1", "b", 1.0), seen("c1", "b", 4.0), seen("c1", "b", 2.0)])
    assert outcome(opps)["t_viewed"] == 2.0


def test_one_event_serves_overlapping_sends(spark):
    opps = build(spark, [sent("c1", "b", 0.0), sent("c1", "b", 3.0), done("c1", "b", 4.0)])
    assert [r["completed"] for r in opps.collect()] == [1, 1]


def test_completion_needs_no_view(spark):
    row = outcome(build(spark, [sent("c1", "b", 0.0), done("c1", "b", 1.0), seen("c1", "b", 2.0)]))
    assert row["completed"] == 1 and row["t_viewed"] == 2.0


def test_duplicate_sends_collapse(spark):
    assert build(spark, [sent("c1", "b", 0.0)] * 3 + [sent("c1", "b", 7.0)]).count() == 2


def test_other_customers_and_offers_do_not_count(spark):
    opps = build(spark, [sent("c1", "b", 0.0), seen("c2", "b", 1.0), seen("c1", "d", 1.0)])
    assert outcome(opps)["viewed"] == 0


def test_missing_keys_are_kept_and_match_nothing(spark):
    opps = build(
        spark, [sent(None, "b", 0.0), seen(None, "b", 1.0), sent("c1", None, 0.0), seen("c1", None, 1.0), paid(None, 2.0)]
    )
    assert opps.count() == 2 and opps.agg(F.sum("viewed")).first()[0] == 0


def test_unknown_offer_is_kept(spark):
    row = outcome(build(spark, [sent("c1", "gone", 0.0), seen("c1", "gone", 0.5)]))
    assert row["offer_type"] is None and row["informational_success"] is None and row["viewed"] == 0


def test_informational_success(spark):
    opps = build(
        spark,
        [
            sent("c1", "i", 0.0), seen("c1", "i", 1.0), paid("c1", 1.0),
            sent("c2", "i", 0.0), paid("c2", 0.5), seen("c2", "i", 1.0), paid("c2", 4.5),
            sent("c3", "i", 0.0), paid("c3", 1.0),
            sent("c4", "b", 0.0), seen("c4", "b", 0.0), paid("c4", 1.0),
        ],
    )
    found = {r["customer_id"]: r["informational_success"] for r in opps.collect()}
    assert found == {"c1": 1, "c2": 0, "c3": 0, "c4": None}


def test_window_form_equals_join_form(spark, campaign):
    columns = ["opp_id", "t_viewed", "t_completed"]
    joined = attribution.attribution_by_join(campaign.events, campaign.offers)
    assert small.rows(campaign.opps.select(columns)) == small.rows(joined.select(columns))


def test_cutting_hot_customers_changes_nothing(spark, campaign):
    everybody = hot_keys(campaign.events, F.col("account_id"), 1)
    assert everybody
    cut = attribution.opportunities(campaign.events, campaign.offers, campaign.profile, everybody)
    assert small.rows(cut) == small.rows(campaign.opps)
    assert small.rows(metrics.send_rank(cut, everybody)) == small.rows(metrics.send_rank(campaign.opps))


def test_cutting_customers_with_null_keys_changes_nothing(spark):
    rows = [
        *[sent(c, o, t) for c in ("a", None) for o in ("b", None, "gone") for t in (0.0, 7.0, 14.0)],
        seen("a", "b", 8.0), seen("a", "gone", 8.0), done("a", "b", 9.0), paid("a", 9.0), paid(None, 9.0),
    ]
    events = cleaning.flatten_transactions(small.transactions(spark, rows))
    offers, profile = small.offers(spark), cleaning.clean_profile(small.profile(spark))
    everybody = hot_keys(events, F.col("account_id"), 1)
    assert len(everybody) == 2
    whole = attribution.opportunities(events, offers, profile, [])
    cut = attribution.opportunities(events, offers, profile, everybody)
    assert small.rows(cut) == small.rows(whole)
    ranks = small.rows(metrics.send_rank(cut, everybody))
    assert ranks == small.rows(metrics.send_rank(whole, []))
    assert sorted(r[-1] for r in ranks) == sorted([1, 2, 3] * 6)
    history = [small.rows(features.history(events, hot=hot)) for hot in ([], everybody)]
    assert history[0] == history[1]


def test_partitioning_changes_nothing(spark, campaign):
    shuffled = campaign.events.repartition(13, F.rand(7))
    again = attribution.opportunities(shuffled, campaign.offers, campaign.profile)
    assert small.rows(again) == small.rows(campaign.opps)


def test_no_carry_without_hot_customers(campaign):
    plan = campaign.opps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "__bucket" not in plan


def test_one_key_with_a_third_of_the_rows(spark):
    """A hot key is found and its running values are those of a plain loop."""
    n = 3000
    line = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("account_id"),
        (F.col("id") / 50).alias("t"),
        (F.col("id") % 7).alias("v"),
    )
    hot = hot_keys(line, F.col("account_id"), 500)
    assert len(hot) == 1
    cut = line.withColumnRenamed("account_id", "customer_id")
    found = attribution.running_in_time(
        cut, hot, ["customer_id"], ["t"], [Measure("total", F.col("v")), Measure("low", F.col("v"), "min")], width=1.0
    )
    total, low = 0, None
    for row in found.where("customer_id = 0").orderBy("t").collect():
        assert (row["total"], row["low"]) == (total, low)
        total, low = total + row["v"], row["v"] if low is None else min(low, row["v"])


def test_running_backwards_with_buckets(spark):
    line = spark.createDataFrame([("a", i, i // 3) for i in range(10)], "k string, t int, b int")
    found = running(line, ["k"], ["t"], [Measure("s", F.col("t")), Measure("m", F.col("t"), "max")], bucket="b", inclusive=True, descending=True)
    assert {r["t"]: (r["s"], r["m"]) for r in found.collect()} == {t: (sum(range(t, 10)), 9) for t in range(10)}


def test_checks_report_problems(spark):
    opps = build(spark, [sent("c1", "b", 0.0), sent("c1", "b", 3.0), done("c1", "b", 4.0, 9.0)])
    events = cleaning.flatten_transactions(small.transactions(spark, [done("c1", "b", 4.0, 9.0), done("c1", "gone", 4.0)]))
    log = cleaning.event_log(events, cleaning.clean_profile(small.profile(spark)), small.offers(spark))
    assert small.rows(quality.reward_matches_discount(log)) == [(False, 1), (None, 1)]
    assert quality.completion_overcount(events.limit(1), opps).first()["difference"] == 1
    assert quality.key_uniqueness(opps.union(opps), "opp_id").first()[0] == 2
    rounds = {r["round_day"]: (r["expected"], r["observed"]) for r in quality.round_check(opps).collect()}
    assert rounds[3] == (0, 1) and rounds[0] == (1, 1) and rounds[24] == (1, 0)


def test_an_event_counts_for_the_latest_send_only(spark):
    rows = [
        sent("c1", "b", 0.0), sent("c1", "b", 3.0), sent("c1", "b", 3.0), seen("c1", "b", 2.0), seen("c1", "b", 4.0),
        done("c1", "b", 3.0), done("c1", "b", 8.5), sent("c2", "b", 0.0), sent("c2", "b", 2.0), done("c2", "b", 1.0), done("c2", "b", 6.0),
        sent(None, "b", 1.0), seen(None, "b", 1.5), sent("c1", None, 1.0), sent("c1", "zz", 1.0), seen("c1", "zz", 1.0),
    ]
    events = cleaning.flatten_transactions(small.transactions(spark, rows))
    for hot in ([], None):
        opps = attribution.opportunities(events, small.offers(spark), cleaning.clean_profile(small.profile(spark)), hot, attribution.LATEST_SEND)
        found = small.rows(opps.select("customer_id", "offer_id", "t_received", "t_viewed", "t_completed"))
        assert found == sorted(
            [
                ("c1", "b", 0.0, 2.0, None), ("c1", "b", 3.0, 4.0, 3.0), ("c2", "b", 0.0, None, 1.0), ("c2", "b", 2.0, None, 6.0),
                (None, "b", 1.0, None, None), ("c1", None, 1.0, None, None), ("c1", "zz", 1.0, None, None),
            ],
            key=repr,
        )


def test_offers_are_joined_without_a_shuffle_on_their_key(campaign):
    spark = campaign.offers.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (campaign.log, campaign.opps, campaign.contexts):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin [offer_id" in line]
            assert not joins and "BroadcastHashJoin [offer_id" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    many = spark.range(30).select(F.col("id").cast("string").alias("id"))
    assert cleaning.small_dimension(many, most=20) is many


def test_customers_are_dealt_out_once(spark):
    """Without hot customers sums and sorts share the exchange by customer, also across the purchases' union."""
    rng = random.Random(5)
    kinds = (sent, seen, done)
    rows = [rng.choice(kinds)(f"c{rng.randrange(30)}", rng.choice("bdi"), rng.randrange(40) / 4) for _ in range(500)]
    rows += [paid(f"c{rng.randrange(12)}", rng.randrange(60) / 4) for _ in range(100)]
    rows += [sent(None, "b", 1.0), sent("c1", None, 2.0), seen(None, "b", 1.5), paid(None, 3.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        events = cleaning.flatten_transactions(small.transactions(spark, rows))
        offers, profile = cleaning.small_dimension(small.offers(spark)), F.broadcast(cleaning.clean_profile(small.profile(spark)))
        opps = attribution.opportunities(events, offers, profile, hot=())
        plan = opps._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(customer_id") == 2
        everyone = [r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "c string").select(F.xxhash64("c")).distinct().collect()]
        assert small.rows(opps) == small.rows(build(spark, rows, hot=everyone))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
