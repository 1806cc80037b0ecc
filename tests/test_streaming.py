import numpy as np
import pytest
import small
from pyspark.sql import functions as F
from small import done, paid, seen, sent

from offerscope.operators import cleaning, posterior
from offerscope.streaming import attribution, files, posterior as online


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each stateful operator has a state store per partition and batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, folder, batches):
    """One parquet file per batch, in order."""
    for rows in batches:
        events = cleaning.flatten_transactions(small.transactions(spark, rows))
        events.coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def attributed(spark, tmp_path, batches, delay):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = feed(spark, source, batches)
    stream = attribution.attribute_stream(files.event_stream(spark, source, schema), small.offers(spark), delay)
    files.run_to_files(stream, out, checkpoint)
    return attribution.latest(spark.read.parquet(out))


def test_outcomes_across_batches_and_out_of_order(spark, tmp_path):
    batches = [
        [seen("c1", "b", 2.0), sent("c2", "d", 0.0)],
        [sent("c1", "b", 1.0), done("c1", "b", 6.0)],
        [seen("c1", "b", 1.5), sent("c2", "d", 0.0), seen("c2", "d", 7.0)],
    ]
    found = attributed(spark, tmp_path, batches, "30 days")
    assert small.rows(found) == [("c1", "b", 1.0, 6.0, 1.5, 6.0), ("c2", "d", 0.0, 7.0, 7.0, None)]


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    batches = [
        [sent("c1", "b", 1.0), seen("c1", "b", 2.0)],
        [sent("c1", "b", 20.0)],
        [seen("c1", "b", 21.0)],
        [done("c1", "b", 3.0)],
    ]
    found = attributed(spark, tmp_path, batches, "1 day")
    assert small.rows(found) == [("c1", "b", 1.0, 6.0, 2.0, None), ("c1", "b", 20.0, 25.0, 21.0, None)]


def test_sends_without_customer_or_offer_are_kept_without_outcome(spark, tmp_path):
    batches = [
        [sent(None, "b", 1.0), sent("c1", None, 2.0), seen(None, "b", 1.5), seen("c1", None, 3.0)],
        [sent(None, "b", 1.0), sent(None, None, 4.0), done(None, "b", 2.0), sent("c1", "b", 5.0), seen("c1", "b", 6.0)],
    ]
    found = attributed(spark, tmp_path, batches, "30 days")
    assert small.rows(found) == sorted(
        [(None, "b", 1.0, 6.0, None, None), ("c1", None, 2.0, None, None, None), (None, None, 4.0, None, None, None), ("c1", "b", 5.0, 10.0, 6.0, None)],
        key=repr,
    )


def test_no_python_in_the_plan(spark, tmp_path):
    schema = feed(spark, str(tmp_path / "in"), [[sent("c1", "b", 1.0)]])
    events = files.event_stream(spark, str(tmp_path / "in"), schema)
    for stream in (attribution.attribute_stream(events, small.offers(spark)), attribution.label_stream(events, small.offers(spark))):
        plan = stream._jdf.queryExecution().toString()
        assert "StreamingSymmetricHashJoin" in plan or "Join" in plan
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def labelled(spark, tmp_path, batches, delay="30 days", beats=2):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = feed(spark, source, batches)
    for _ in range(beats):
        log = spark.read.parquet(source).where(F.col("event") != attribution.HEARTBEAT)
        attribution.heartbeat(log, small.offers(spark), 30).write.mode("append").parquet(source)
    stream = attribution.label_stream(files.event_stream(spark, source, schema), small.offers(spark), delay)
    files.run_to_files(stream, out, checkpoint)
    return sorted((r["customer_id"], r["offer_id"], r["t_received"], r["reward"]) for r in spark.read.parquet(out).fillna("-").collect())


def test_labels_come_once_from_chained_events(spark, tmp_path):
    batches = [
        [sent("c1", "i", 1.0), sent("c2", "i", 1.0), sent("c3", "i", 1.0), sent("c1", "b", 1.0), sent("c1", "i", 1.0)],
        [paid("c1", 2.0), seen("c1", "i", 2.0), done("c1", "b", 6.0), done("c1", "b", 6.0), paid("c2", 2.0)],  # equal times count
        [seen("c2", "i", 3.0), seen("c3", "i", 5.0), paid("c3", 5.0), paid("c2", 5.5)],  # c2: paid before the view, then too late
        [sent(None, "i", 2.0), sent("c4", None, 2.0), sent("c4", "unknown", 2.0), seen(None, "i", 2.5), paid(None, 3.0), seen("c4", "i", 2.0)],
    ]
    assert labelled(spark, tmp_path, batches) == [
        ("-", "i", 2.0, 0), ("c1", "b", 1.0, 1), ("c1", "i", 1.0, 1), ("c2", "i", 1.0, 0), ("c3", "i", 1.0, 1),
        ("c4", "-", 2.0, 0), ("c4", "unknown", 2.0, 0),
    ]


def test_out_of_order_and_late_events_of_labels(spark, tmp_path):
    batches = [
        [paid("c1", 3.0), seen("c1", "i", 2.0), done("c2", "d", 4.0)],
        [sent("c1", "i", 1.0), sent("c2", "d", 1.0), sent("c3", "d", 1.0)],
        [sent("c9", "d", 40.0)],
        [sent("c9", "d", 41.0)],
        [done("c3", "d", 2.0)],  # behind the watermark
    ]
    found = labelled(spark, tmp_path, batches, delay="5 days")
    assert found == [("c1", "i", 1.0, 1), ("c2", "d", 1.0, 1), ("c3", "d", 1.0, 0), ("c9", "d", 40.0, 0), ("c9", "d", 41.0, 0)]


def test_online_posterior_query_equals_rounds_in_turn(campaign):
    from offerscope.plans import catalog

    arms = posterior.prior_arms(campaign.values, campaign.n_features)
    for day in sorted(r[0] for r in campaign.design.select("round_day").distinct().collect()):
        rows = campaign.design.where(F.col("round_day") == day).select(F.col("offer_id").alias("model"), "x", "reward")
        arms, _ = posterior.update_arms(rows, arms)
    found = {(r["offer_id"], r["feature"]): r["weight"] for r in catalog.run("online_posterior", campaign).collect()}
    assert len(found) == len(arms) * campaign.n_features
    for a in arms:
        for name, weight in zip(campaign.feature_names, a.m):
            assert abs(found[a.offer_id, name] - weight) < 1e-5


def test_online_posterior_equals_batches_in_turn(spark, campaign, tmp_path):
    outcomes = campaign.design.select("offer_id", "x", "reward", "round_day")
    source = str(tmp_path / "outcomes")
    parts = [outcomes.where("round_day < 10"), outcomes.where("round_day >= 10")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    prior = posterior.prior_arms(campaign.values, campaign.n_features)
    stream = files.event_stream(spark, source, outcomes.schema)
    table = str(tmp_path / "posterior")
    online.run_updates(stream, table, str(tmp_path / "check"), prior)
    arms = prior
    for part in parts:
        arms, _ = posterior.update_arms(part.select(F.col("offer_id").alias("model"), "x", "reward"), arms)
    stored = posterior.collect_arms(spark.read.parquet(online.version_path(table, 1)))
    for a, b in zip(arms, stored):
        assert a.offer_id == b.offer_id and np.allclose(a.m, b.m) and np.allclose(a.q, b.q)
    # running the last batch again gives the same version
    online.batch_updater(table, prior)(parts[1], 1)
    again = posterior.collect_arms(spark.read.parquet(online.version_path(table, 1)))
    assert all(np.allclose(a.m, b.m) for a, b in zip(stored, again))


def test_batches_and_state_do_not_follow_the_sessions_partitions(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    monkeypatch.setattr(files, "STATE_ROWS", 8)
    monkeypatch.setattr(files, "LEAST_PARTITIONS", 2)
    rows = [event for n in range(20) for event in (sent(f"c{n}", "d", n / 10), done(f"c{n}", "d", 1.0 + n / 10))]
    events = cleaning.flatten_transactions(small.transactions(spark, rows))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    files.write_log(events, "time_since_test_start", source)
    names = [p for p in (tmp_path / "in").iterdir() if p.name.startswith("part-")]
    assert 1 < len(names) <= files.REPLAY_FILES
    # files hold consecutive times
    held = sorted((t[0], t[1]) for t in (spark.read.parquet(str(p)).agg(F.min("time_since_test_start"), F.max("time_since_test_start")).first() for p in names) if t[0] is not None)
    assert all(a[1] < b[0] for a, b in zip(held, held[1:]))
    assert files.state_partitions(spark, source) == 5
    stream = attribution.attribute_stream(files.event_stream(spark, source, events.schema, 100), small.offers(spark))
    files.run_to_files(stream, out, checkpoint, files.state_partitions(spark, source))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    stores = {p.name for p in (tmp_path / "check/state/0").iterdir() if p.name.isdigit()}
    assert stores == {"0", "1", "2", "3", "4"}
    found = attribution.latest(spark.read.parquet(out)).collect()
    assert len(found) == 20 and all(abs(r["t_completed"] - r["t_received"] - 1) < 1e-9 for r in found)
