import hashlib

import numpy as np
import pytest
import small
from pyspark.sql import functions as F

from offerscope.functions import draws
from offerscope.operators import policies, posterior, scoring
from offerscope.operators.posterior import Arm, Model, fit


def brute_mode(x, y, m, q):
    """Mode of the penalised likelihood by plain gradient-free Newton in one process."""
    w = m.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(q)
        w = w - 0.5 * np.linalg.solve(h, q * (w - m) + x.T @ (p - y))
    return w


def local(design):
    rows = design.select("offer_id", "x", "reward").collect()
    return [r["offer_id"] for r in rows], np.array([r["x"] for r in rows]), np.array([r["reward"] for r in rows], float)


def test_posterior_equals_brute_force(campaign):
    offers, x, y = local(campaign.design)
    prior = posterior.prior_arms(campaign.values, campaign.n_features)
    arms, sums = posterior.update_arms(
        campaign.design.select(F.col("offer_id").alias("model"), "x", "reward"), prior
    )
    for arm in arms:
        mine = np.array([o == arm.offer_id for o in offers])
        m, q = np.zeros(x.shape[1]), np.ones(x.shape[1])
        w = brute_mode(x[mine], y[mine], m, q)
        assert np.allclose(arm.m, w, atol=1e-6)
        p = 1 / (1 + np.exp(-(x[mine] @ w)))
        assert np.allclose(arm.q, q + (x[mine] ** 2 * (p * (1 - p))[:, None]).sum(0), atol=1e-5)
        assert sums[arm.offer_id].n == mine.sum() and sums[arm.offer_id].rewards == y[mine].sum()


def test_arm_without_rows_keeps_its_prior(campaign):
    arm = Arm("never sent", 1.0, (0.0,) * campaign.n_features, (1.0,) * campaign.n_features)
    rows = campaign.design.select(F.col("offer_id").alias("model"), "x", "reward")
    others = posterior.prior_arms(campaign.values, campaign.n_features)
    assert posterior.update_arms(rows, [*others, arm])[0][-1] == arm


def test_fit_does_not_depend_on_partitioning(campaign):
    rows = campaign.design.select(F.col("offer_id").alias("model"), "x", "reward")
    prior = posterior.prior_arms(campaign.values, campaign.n_features)
    one, many = (posterior.update_arms(rows.repartition(n), prior)[0] for n in (1, 11))
    for a, b in zip(one, many):
        assert np.allclose(a.m, b.m, atol=1e-9)


def test_separable_rows_stay_finite(spark):
    rows = spark.createDataFrame([("a", [1.0, 5.0], 1), ("a", [1.0, -5.0], 0)] * 3, "model string, x array<double>, reward int")
    model = Model(np.zeros(2), np.array([0.0, 1e-6]), np.zeros(2))
    fit(rows, {"a": model})
    assert np.isfinite(model.w).all()


def test_response_models_equal_the_library_fit(campaign):
    """One arm against Spark's own logistic regression with the same penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    arm = campaign.response_models[0]
    rows = campaign.design.where(F.col("offer_id") == arm.offer_id)
    n = rows.count()
    fitted = LogisticRegression(
        labelCol="reward", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12
    ).fit(rows.select("reward", array_to_vector(F.slice("x", 2, campaign.n_features - 1)).alias("features")))
    assert np.allclose([fitted.intercept, *fitted.coefficients], arm.m, atol=1e-4)


def test_ties_go_to_the_smallest_id(spark):
    arms = [Arm(o, 2.0, (0.0,), (1.0,)) for o in ("a", "b", "c")]
    df = spark.createDataFrame([([1.0],)], "x array<double>")
    assert df.select(policies.best_of(policies.map_scores(arms))["offer_id"]).first()[0] == "a"


def test_draws_are_normal_and_repeatable(spark):
    df = spark.range(20000).select(draws.normal(F.col("id").cast("string")).alias("z"), draws.uniform(F.col("id").cast("string")).alias("u"))
    row = df.agg(F.avg("z"), F.stddev("z"), F.avg(F.pow("z", F.lit(4))), F.min("u"), F.max("u")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and abs(row[2] - 3) < 0.3
    assert 0 < row[3] and row[4] < 1
    assert small.rows(df) == small.rows(df.repartition(5))


def test_thompson_score_has_the_spread_of_weight_draws(spark):
    """The one-draw logit has the moments of m.x over drawn weight vectors."""
    arm = Arm("a", 1.0, (0.3, -0.2), (4.0, 1.0))
    df = spark.range(20000).select(F.col("id").cast("string").alias("opp_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    p = policies.best_of(policies.thompson_scores([arm]))["p"]
    row = df.select(F.log(p / (1 - p)).alias("z")).agg(F.avg("z"), F.variance("z")).first()
    assert abs(row[0] - (-0.1)) < 0.05 and abs(row[1] - (1 / 4 + 4 / 1)) < 0.15


def test_replay_of_the_log_keeps_everything(campaign):
    row = policies.replay(campaign.design, {"logged": F.col("offer_id")}).first()
    assert row["kept_share"] == 1.0
    assert abs(row["conversion_rate"] - campaign.design.agg(F.avg("reward")).first()[0]) < 1e-12


def test_policy_that_keeps_nothing_has_no_rate(campaign):
    row = policies.replay(campaign.design, {"none": F.lit("no such offer")}).first()
    assert row["n_kept"] == 0 and row["conversion_rate"] is None


def test_random_policy_keeps_one_in_arms(spark):
    ids = [f"o{i}" for i in range(10)]
    df = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("opp_id"))
    found = df.groupBy(policies.random_offer(ids).alias("o")).count().collect()
    assert len(found) == 10 and all(abs(r["count"] - 2000) < 250 for r in found)


def test_learning_replay_equals_a_plain_loop(campaign):
    """Round by round in one process: same choices, same kept rows, same weights."""
    design, values, d = campaign.design, campaign.values, campaign.n_features
    by_round, arms = policies.thompson_replay(design, values, d, (1.0, 3.0))
    for precision in (1.0, 3.0):
        state = {o: (np.zeros(d), np.full(d, precision)) for o in values}
        days = sorted({r["round_day"] for r in design.select("round_day").distinct().collect()})
        for number, day in enumerate(days):
            salt = scoring.salts([f"{o}|{policies.SEED + number}" for o in sorted(values)])
            rows = design.where(F.col("round_day") == day).select("opp_id", "offer_id", "x", "reward").collect()
            kept = []
            for r in rows:
                x = np.array(r["x"])
                digest = hashlib.md5(r["opp_id"].encode()).hexdigest()
                words = (np.array([int(digest[at : at + 8], 16)]) for at in (0, 8))
                noise = dict(zip(sorted(values), scoring.keyed_normals(*words, salt)[0]))
                score = {
                    o: values[o] / (1 + np.exp(-(m @ x + noise[o] * np.sqrt((x**2 / q).sum())))) for o, (m, q) in state.items()
                }
                if max(sorted(score), key=score.get) == r["offer_id"]:
                    kept.append((r["offer_id"], x, r["reward"]))
            expected = by_round.where((F.col("prior_precision") == precision) & (F.col("round_day") == day)).first()
            assert expected["n_kept"] == len(kept) and expected["reward"] == sum(k[2] for k in kept)
            for o in {k[0] for k in kept}:
                x = np.array([k[1] for k in kept if k[0] == o])
                y = np.array([k[2] for k in kept if k[0] == o], float)
                m, q = state[o]
                w = brute_mode(x, y, m, q)
                p = 1 / (1 + np.exp(-(x @ w)))
                state[o] = (w, q + (x**2 * (p * (1 - p))[:, None]).sum(0))
        for arm in arms[precision]:
            assert np.allclose(arm.m, state[arm.offer_id][0], atol=1e-5)


def test_no_policy_is_scored_by_arms_that_saw_the_round(campaign):
    """The arms of a round are those of a replay that ends before it."""
    _, _, history = campaign.learning
    for day, _, arms in history:
        before = campaign.design.where(F.col("round_day") < F.lit(day))
        _, expected = policies.thompson_replay(before, campaign.values, campaign.n_features)
        for a, b in zip(arms[1.0], expected[1.0]):
            assert a.offer_id == b.offer_id and np.allclose(a.m, b.m, atol=1e-9) and np.allclose(a.q, b.q, atol=1e-9)


def test_thompson_row_of_the_comparison_is_the_learning_replay(campaign):
    row = policies.replay(campaign.design, campaign.policies()).where("policy = 'thompson'").first()
    total = campaign.learning[0].agg(F.sum("n_kept"), F.sum("reward"), F.sum("gain")).first()
    assert row["n_kept"] == total[0]
    assert abs(row["conversion_rate"] * total[0] - total[1]) < 1e-9
    assert abs(row["value_per_contact"] * total[0] - total[2]) < 1e-6


def test_recommendations_are_those_of_the_trained_arms(campaign):
    arms = campaign.trained_arms
    rows = {r["opp_id"]: r["x"] for r in campaign.design.select("opp_id", "x").collect()}
    ranked = policies.recommend(campaign.design, policies.map_scores(arms)).collect()
    by_row = {}
    for r in ranked:
        by_row.setdefault(r["opp_id"], []).append(r)
    assert set(by_row) == set(rows)
    for opp_id, found in by_row.items():
        score = {a.offer_id: a.value / (1 + np.exp(-np.dot(a.m, rows[opp_id]))) for a in arms}
        expected = sorted(score, key=lambda o: (-score[o], o))
        assert [r["offer_id"] for r in sorted(found, key=lambda r: r["offer_rank"])] == expected
        assert all(abs(r["expected_value"] - score[r["offer_id"]]) < 1e-9 for r in found)
    share = {r["offer_id"]: r["n"] for r in policies.recommended_share(campaign.design, policies.map_scores(arms)).collect()}
    tops = [next(r["offer_id"] for r in found if r["offer_rank"] == 1) for found in by_row.values()]
    assert share == {o: tops.count(o) for o in set(tops)}


def test_rows_of_unknown_offers_are_left_out_of_fits(spark, campaign):
    known = campaign.design.select(F.col("offer_id").alias("model"), "x", "reward")
    unknown = known.limit(3).withColumn("model", F.lit("no such offer")).unionByName(
        known.limit(1).withColumn("model", F.lit(None).cast("string"))
    )
    prior = posterior.prior_arms(campaign.values, campaign.n_features)
    expected, found = (posterior.update_arms(rows, prior)[0] for rows in (known, known.unionByName(unknown)))
    for a, b in zip(expected, found):
        assert np.allclose(a.m, b.m, atol=1e-9)


def test_values_need_no_join(campaign):
    plan = policies.with_values(campaign.design.drop("value"), campaign.values)._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()


def test_only_candidates_are_chosen(spark):
    arms = [Arm(o, v, (0.0,), (1.0,)) for o, v in (("a", 1.0), ("b", 3.0), ("c", 2.0))]
    df = spark.createDataFrame([([1.0],)], "x array<double>")
    assert df.select(policies.best_of(policies.map_scores(arms), ["a", "c"])["offer_id"]).first()[0] == "c"


def test_deciles_cover_all_rows(campaign):
    by_decile = policies.calibration_deciles(campaign.design, campaign.response_models)
    assert by_decile.agg(F.sum("n")).first()[0] == campaign.design.count()


def test_calibration_on_rounds_not_fitted(campaign):
    early = campaign.design.where("round_day < 24")
    models = posterior.fit_response_models(early, campaign.values, campaign.n_features)
    held_out = policies.calibration(campaign.design.where("round_day = 24"), models)
    assert held_out.where("predicted_avg NOT BETWEEN 0 AND 1").count() == 0


def test_oracle_policy_has_no_regret(campaign):
    scores = policies.map_scores(campaign.arms)
    best = policies.best_of(scores)["offer_id"]
    regret = policies.policy_regret(campaign.design, scores, {"best": best, "random": policies.random_offer(list(campaign.values))})
    for r in regret.collect():
        assert r["mean_regret"] == 0 if r["policy"] == "best" else r["mean_regret"] >= 0


@pytest.mark.parametrize("n,parts", [(3, 8), (16, 8), (17, 8), (100, 7)])
def test_ntile(spark, n, parts):
    from pyspark.sql import Window

    df = spark.range(n).select(
        policies.ntile(F.col("id"), F.lit(n).cast("long"), parts).alias("mine"), F.ntile(parts).over(Window.orderBy("id")).alias("theirs")
    )
    assert df.where("mine <> theirs").count() == 0


def test_too_many_arms_are_refused(spark, monkeypatch):
    monkeypatch.setattr(posterior, "MAX_MODELS", 2)
    with pytest.raises(ValueError, match="small dimension"):
        posterior.collect_arms(spark.range(3).select(F.col("id").cast("string").alias("offer_id")))


def numpy_diagonal(rows, m, q, steps=3):
    """The update straight from its formulas: rows of (x, y)."""
    w = m.copy()
    for _ in range(steps):
        p = np.array([1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) for x, _ in rows])
        slope = q * (w - m) + sum((a - y) * x for a, (x, y) in zip(p, rows))
        w = w - np.clip(slope / (q + sum(x * x * a * (1 - a) for a, (x, _) in zip(p, rows))), -2, 2)
    p = np.array([1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) for x, _ in rows])
    return w, q + sum(x * x * a * (1 - a) for a, (x, _) in zip(p, rows))


def test_diagonal_steps_equal_their_formulas(spark):
    rng = np.random.default_rng(1)
    rows = [(f"o{i % 2}", rng.normal(size=4).tolist(), int(rng.random() < 0.4)) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, x array<double>, reward int").repartition(5)
    arms = [posterior.Arm(o, 1.0, (0.1, 0.0, -0.2, 0.3), (1.0, 2.0, 0.5, 3.0)) for o in ("o0", "o1", "o2")]
    updated, sums = posterior.diagonal_update(df, arms)
    for a, before in zip(updated, arms):
        mine = [(np.array(x), y) for o, x, y in rows if o == a.offer_id]
        if not mine:
            assert a == before and a.offer_id not in sums
            continue
        w, q = numpy_diagonal(mine, np.array(before.m), np.array(before.q))
        assert np.allclose(a.m, w) and np.allclose(a.q, q) and sums[a.offer_id].n == len(mine)


def test_heldout_models_saw_earlier_rounds_only(campaign):
    folds = campaign.heldout_models
    days = sorted(r[0] for r in campaign.design.select("round_day").distinct().collect())
    assert [d for d, _ in folds] == days[1:]
    for day, arms in (folds[0], folds[-1]):
        alone = posterior.fit_response_models(campaign.design.where(F.col("round_day") < day), campaign.values, campaign.n_features)
        for a, b in zip(arms, alone):
            assert a.offer_id == b.offer_id and np.allclose(a.m, b.m, atol=1e-5)
    scored = policies.heldout_scores(campaign.design, folds)
    assert scored.where(F.col("round_day") == days[0]).isEmpty()
    assert scored.count() == campaign.design.where(F.col("round_day") > days[0]).count()
    by_day = {d: {a.offer_id: np.array(a.m) for a in arms} for d, arms in folds}
    rows = {r["opp_id"]: r for r in campaign.design.collect()}
    for r in scored.limit(50).collect():
        x = np.array(rows[r["opp_id"]]["x"])
        assert abs(r["p"] - 1 / (1 + np.exp(-x @ by_day[r["round_day"]][r["offer_id"]]))) < 1e-9


def test_slices_of_time_are_bounded(spark):
    times = spark.range(5000).select((F.col("id") / 7).cast("int").alias("round_day"))
    slices = posterior.time_slices(times, most=12)
    assert 6 <= len(slices) <= 13 and slices[0][0] == 0 and slices[-1][1] == 4999 // 7
    assert all(a[1] < b[0] for a, b in zip(slices, slices[1:]))
    sizes = [times.where(posterior.in_slice("round_day", *s)).count() for s in slices]
    assert sum(sizes) == 5000 and max(sizes) < 1000
    few = times.where("round_day < 5").unionByName(spark.createDataFrame([(None,)], "round_day int"))
    assert posterior.time_slices(few, most=12) == [(None, None), *[(d, d) for d in range(5)]]


def test_a_replay_by_slices_of_rounds_is_the_replay_by_rounds(campaign):
    run = lambda n: policies.thompson_replay(campaign.design, campaign.values, campaign.n_features, slices=n)[0]
    whole = [tuple(r) for r in run(500).collect()]
    assert [tuple(r) for r in run(6).collect()] == whole
    assert 1 <= run(2).count() <= 3
