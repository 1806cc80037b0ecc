import datetime

import small
from pyspark.sql import functions as F

from offerscope.functions.columns import age_band
from offerscope.operators import cleaning
from offerscope.sources import files, schemas


def test_profile(spark):
    found = {r["id"]: r for r in cleaning.clean_profile(small.profile(spark)).collect()}
    assert found["c1"]["gender"] == "M" and found["c1"]["registered_on_date"] == datetime.date(2017, 2, 15)
    assert found["c2"]["age"] is None and found["c2"]["gender"] == "Unknown"
    assert found["c3"]["gender"] == "F" and found["c3"]["registered_on_date"] is None
    assert found["c4"]["gender"] == "Unknown" and found["c4"]["age"] == 20


def test_whole_number_dates_and_text_numbers(spark):
    raw = spark.createDataFrame([("a", "118", "F", "oops", 20170215)], "id string, age string, gender string, credit_card_limit string, registered_on int")
    row = cleaning.clean_profile(raw).first()
    assert row["age"] is None and row["credit_card_limit"] is None
    assert row["registered_on_date"] == datetime.date(2017, 2, 15)


def test_both_spellings_of_the_offer_key(spark):
    flat = cleaning.flatten_transactions(
        small.transactions(spark, [small.sent("c1", "b", 0.0), small.seen("c1", "b", 1.0), small.paid("c1", 2.0, 7.5)])
    )
    assert [tuple(r) for r in flat.orderBy("time_since_test_start").select("offer_id", "amount").collect()] == [
        ("b", None),
        ("b", None),
        (None, 7.5),
    ]
    assert "value" not in flat.columns


def test_log_keeps_every_event(spark):
    events = cleaning.flatten_transactions(
        small.transactions(
            spark, [small.sent("c1", "b", 0.0), small.sent("nobody", "unknown", 0.0), small.paid(None, 1.0)]
        )
    )
    log = cleaning.event_log(events, cleaning.clean_profile(small.profile(spark)), small.offers(spark))
    assert log.count() == 3 and len(log.columns) == 15
    assert log.where("offer_id = 'unknown'").first()["offer_type"] is None


def test_age_bands(spark):
    ages = spark.createDataFrame([(17,), (24,), (25,), (64,), (65,), (None,)], "age int")
    found = [r[0] for r in ages.select(age_band(F.col("age"))).collect()]
    assert found == ["18-24", "18-24", "25-34", "55-64", "65+", "Unknown"]


def test_json_source(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "offers.json").write_text(
        '{"id": "b", "offer_type": "bogo", "min_value": 5, "duration": 7.0, "discount_value": 5, "channels": ["web"]}\n'
    )
    (folder / "profile.json").write_text(
        '{"id": "c1", "age": 40, "gender": "F", "credit_card_limit": 1000.0, "registered_on": 20170101}\n'
    )
    (folder / "transactions.json").write_text(
        '{"account_id": "c1", "event": "offer viewed", "time_since_test_start": 0.5, "value": {"offer id": "b"}}\n'
        "not json\n"
    )
    raw = files.read_raw(spark, str(folder))
    assert raw.offers.first()["duration"] == 7.0
    assert cleaning.clean_profile(raw.profile).first()["registered_on_date"].year == 2017
    flat = cleaning.flatten_transactions(raw.transactions)
    assert {r["offer_id"] for r in flat.collect()} == {"b", None}
    kept = files.read_json(spark, str(folder / "transactions.json"), schemas.TRANSACTIONS, keep_corrupt=True)
    assert [r[schemas.CORRUPT] for r in kept.collect()] == [None, "not json"]


def test_round_trip(spark, campaign, tmp_path):
    stored = files.verified_write(campaign.opps, str(tmp_path / "opps"))
    assert stored.count() == campaign.opps.count()
    assert sorted(stored.columns) == sorted(campaign.opps.columns)
    one = stored.where("round_day = 7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(round_day" in plan


def test_bad_lines_are_set_aside_with_their_text(spark, tmp_path):
    from offerscope.sources import files, schemas

    folder = tmp_path / "raw"
    folder.mkdir()
    good = '{"id": "b", "offer_type": "bogo", "min_value": 10, "duration": 5, "discount_value": 10, "channels": ["email"]}'
    (folder / "offers.json").write_text(f'{good}\n{good[:40]}\n{{"id": "d", "duration": "soon"}}\n')
    kept, bad = files.read_quarantined(spark, str(folder / "offers.json"), schemas.OFFERS, str(tmp_path / "aside"))
    assert [r["id"] for r in kept.collect()] == ["b"]
    assert sorted(r["line"] for r in bad.collect()) == sorted([good[:40], '{"id": "d", "duration": "soon"}'])
    assert all(r["file"].endswith("offers.json") for r in bad.collect()) and any('"id":"d"' in (r["read"] or "") for r in bad.collect())


def test_a_stored_table_is_brought_up_to_date(spark, tmp_path):
    import os

    import small
    from small import done, paid, seen, sent

    from offerscope.operators import attribution
    from offerscope.sources import files

    profile = cleaning.clean_profile(small.profile(spark))
    build = lambda events: attribution.opportunities(events, small.offers(spark), profile)
    old = [sent("c1", "b", 0.0), done("c1", "b", 1.0), sent("c1", "d", 7.0), sent("c2", "i", 7.0), seen("c2", "i", 8.0), sent("c3", "zz", 7.0)]
    new = [done("c1", "d", 13.0), paid("c2", 10.0), sent("c3", "b", 14.0), seen("c3", "b", 14.0), seen("c1", "d", 14.0)]
    log = lambda rows: cleaning.flatten_transactions(small.transactions(spark, rows))
    path = str(tmp_path / "opps")
    files.write_opportunities(build(log(old)), path)
    untouched = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "opps" / "round_day=0").glob("*.parquet"))}
    files.update_opportunities(path, log(old + new), 10.0, build)
    columns = build(log(old)).columns
    assert small.rows(files.read_opportunities(spark, path).select(*columns)) == small.rows(build(log(old + new)))
    assert untouched == {f: os.stat(f).st_mtime_ns for f in untouched}
