"""Offer-selection policies, their evaluation on logged sends, and money projections.

A policy is a column that names the offer it would send.  Scores of all offers
for a row are an array computed in place: no row is joined to, or repeated for,
every offer unless the ranking itself is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions import draws
from offerscope.operators.metrics import completer_ticket
from offerscope.operators.posterior import MAX_FOLDS, Arm, in_slice, prior_arms, time_slices, update_arms
from offerscope.operators.quantiles import exact_quantiles
from offerscope.operators.scoring import SEED, best_of, map_scores, scores_by_round, thompson_scores
from offerscope.operators.timeline import Measure, running

# The precisions compared by the sweep.
PRIOR_PRECISIONS = (0.1, 0.5, 1.0, 3.0, 10.0)
#: Unscaled columns the example rows are picked by.
EXAMPLE_COLUMNS = (
    "customer_tenure_days",
    "completion_rate_before",
    "transaction_count_before",
    "days_since_last_tx",
)


# -- values and scores ----------------------------------------------------------------------


def arm_values(offers: DataFrame, events: DataFrame, opps: DataFrame) -> DataFrame:
    """Net value of a success: the mean completer purchase less the offer's discount."""
    ticket = completer_ticket(events, opps).scalar()
    return offers.select(
        F.col("id").alias("offer_id"), "offer_type", "discount_value", (ticket - F.col("discount_value")).alias("value")
    )


def with_values(design: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """The value of the logged offer, null for an unknown one.

    The values are few and already checked, so they are a constant map: a join
    would send the feature vectors to as many partitions as there are offers.
    """
    entries = [F.lit(x) for offer in sorted(values) for x in (offer, values[offer])]
    known = F.create_map(*entries) if entries else F.expr("CAST(map() AS map<string, double>)")
    return design.withColumn("value", F.try_element_at(known, F.col("offer_id")))


def random_offer(offer_ids: Sequence[str], seed: int = SEED) -> Column:
    ids = F.array(*[F.lit(o) for o in sorted(offer_ids)])
    return F.get(ids, draws.pick(F.concat_ws("|", F.col("opp_id"), F.lit(str(seed))), len(offer_ids)))


def score_table(design: DataFrame, scores: Column) -> DataFrame:
    """Chosen offer per row with its probability and score."""
    return design.select("*", best_of(scores).alias("__best")).select(
        *design.columns,
        F.col("__best.offer_id").alias("chosen_offer"),
        F.col("__best.p").alias("chosen_p"),
        F.col("__best.score").alias("chosen_score"),
    )


def recommend(design: DataFrame, scores: Column, top: int | None = None) -> DataFrame:
    """Offers per row ranked by score; the ranking sorts inside the row's own array."""
    ranked = F.array_sort(
        F.transform(scores, lambda s: F.struct((-s["score"]).alias("__down"), s["offer_id"], s["p"], s["score"]))
    )
    if top is not None:
        ranked = F.slice(ranked, 1, top)
    return design.select("opp_id", "customer_id", F.posexplode(ranked).alias("__pos", "__entry")).select(
        "opp_id",
        "customer_id",
        (F.col("__pos") + 1).alias("offer_rank"),
        F.col("__entry.offer_id").alias("offer_id"),
        F.col("__entry.p").alias("p"),
        F.col("__entry.score").alias("expected_value"),
    )


def recommended_share(design: DataFrame, scores: Column) -> DataFrame:
    """Share of rows for which each offer comes out on top."""
    total = design.agg(F.count(F.lit(1))).scalar()
    return (
        design.groupBy(best_of(scores)["offer_id"].alias("offer_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("offer_id", "n", (F.col("n") / total).alias("share"))
    )


def mean_scores(design: DataFrame, scores: Column) -> DataFrame:
    """Mean probability and score of every offer over all rows."""
    return (
        design.select(scores.alias("__scores"))
        .select(F.inline("__scores"))
        .groupBy("offer_id")
        .agg(F.avg("p").alias("mean_p"), F.avg("score").alias("expected_value"))
    )


def best_offer_by_value(design: DataFrame, scores: Column) -> DataFrame:
    """The one offer worth most if everybody got it."""
    return mean_scores(design, scores).orderBy(F.desc("expected_value"), "offer_id").limit(1)


# -- replay -----------------------------------------------------------------------------------


def replay(design: DataFrame, policies: Mapping[str, Column]) -> DataFrame:
    """Replay estimate of each policy: keep the rows where it agrees with the log.

    All policies are counted in one pass.  ``design`` carries the value of a
    success of the logged offer.  A policy that keeps nothing has null rates.
    """
    gained = F.col("reward") * F.col("value")
    chosen = design.select("offer_id", "reward", "value", *[c.alias(f"__{name}") for name, c in policies.items()])
    agrees = {name: F.col(f"__{name}") == F.col("offer_id") for name in policies}
    sums = chosen.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[
            F.struct(
                F.lit(name).alias("policy"),
                F.count_if(kept).alias("n_kept"),
                F.sum(F.when(kept, F.col("reward"))).alias("reward"),
                F.sum(F.when(kept, gained)).alias("gain"),
            ).alias(f"p_{name}")
            for name, kept in agrees.items()
        ],
    )
    return sums.select("n_total", F.inline(F.array(*[F.col(f"p_{name}") for name in policies]))).select(
        "policy",
        "n_total",
        "n_kept",
        (F.col("n_kept") / F.nullif("n_total", F.lit(0))).alias("kept_share"),
        (F.col("reward") / F.nullif("n_kept", F.lit(0))).alias("conversion_rate"),
        (F.col("gain") / F.nullif("n_kept", F.lit(0))).alias("value_per_contact"),
    )


def kept_rows(design: DataFrame, policies: Mapping[str, Column]) -> DataFrame:
    """One row per policy and row it agrees on."""
    named = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("chosen_offer")) for n, c in policies.items()])
    agreeing = F.filter(named, lambda p: p["chosen_offer"] == F.col("offer_id"))
    return design.select("*", F.inline(agreeing)).drop("chosen_offer")


def in_log_order(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], digits: int = 3, **how) -> DataFrame:
    """Running measures over rows in order of round and key, cut by leading key digits.

    The key is a digest, so its leading digits split each round evenly and in order.
    """
    cut = df.select("*", F.struct("round_day", F.substring("opp_id", 1, digits)).alias("__slice"))
    return running(cut, keys, ["round_day", "opp_id"], measures, bucket="__slice", **how).drop("__slice")


def replay_running(design: DataFrame, policies: Mapping[str, Column]) -> DataFrame:
    """Cumulative reward and value over the kept rows of each policy."""
    kept = kept_rows(design, policies).select(
        "policy", "round_day", "opp_id", "reward", (F.col("reward") * F.col("value")).alias("gain")
    )
    return in_log_order(
        kept,
        ["policy"],
        [
            Measure("position", F.lit(1).cast("bigint")),
            Measure("cumulative_reward", F.col("reward")),
            Measure("cumulative_value", F.col("gain")),
        ],
        inclusive=True,
    )


def thompson_replay(
    design: DataFrame,
    values: Mapping[str, float],
    n_features: int,
    precisions: Sequence[float] = (1.0,),
    seed: int = SEED,
    history: list | None = None,
    update: Callable = update_arms,
    slices: int = MAX_FOLDS,
) -> tuple[DataFrame, dict[float, list[Arm]]]:
    """Replay of a policy that learns, one send round at a time.

    Offers go out in synchronised rounds and their outcomes arrive later, so a
    round is chosen with the posterior of the rounds before it, for all rows at
    once, and then updates it.  All precisions share each round's passes.
    Returns one row per precision and round, and the final arms.  ``history`` gets
    what each round was chosen with: (round, its draws' seed, arms by precision).
    ``update`` moves the arms: by the full mode of each round, or by diagonal steps.
    With more different send times than ``slices``, that many parts of the log are the rounds.
    """
    spark = design.sparkSession
    arms = {p: prior_arms(values, n_features, p) for p in precisions}
    rows = []
    for number, (day, last) in enumerate(time_slices(design, most=slices)):
        if history is not None:
            history.append((day, seed + number, dict(arms)))
        of_round = design.where(in_slice("round_day", day, last))
        choices = {
            str(p): best_of(thompson_scores(arms[p], seed + number))["offer_id"] for p in precisions
        }
        kept = (
            kept_rows(of_round, choices)
            .select(F.concat_ws("|", "policy", "offer_id").alias("model"), "x", "reward")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        try:
            joint = [Arm(f"{p}|{a.offer_id}", a.value, a.m, a.q) for p in precisions for a in arms[p]]
            updated, sums = update(kept, joint)
        finally:
            kept.unpersist()
        for p in precisions:
            mine = [a for a in updated if a.offer_id.startswith(f"{p}|")]
            found = [(a.value, sums[a.offer_id]) for a in mine if a.offer_id in sums]
            rows.append(
                (
                    float(p),
                    day,
                    int(sum(s.n for _, s in found)),
                    float(sum(s.rewards for _, s in found)),
                    float(sum(v * s.rewards for v, s in found)),
                )
            )
            arms[p] = [Arm(a.offer_id.split("|", 1)[1], a.value, a.m, a.q) for a in mine]
    schema = "prior_precision double, round_day int, n_kept long, reward double, gain double"
    return spark.createDataFrame(rows, schema), arms


def learning_curve(by_round: DataFrame) -> DataFrame:
    """The rounds of a learning replay with cumulative reward and value; a handful of rows."""
    upto = Window.partitionBy("prior_precision").orderBy("round_day").rowsBetween(Window.unboundedPreceding, 0)
    return by_round.select(
        "*", F.sum("reward").over(upto).alias("cumulative_reward"), F.sum("gain").over(upto).alias("cumulative_value")
    )


def learning_summary(by_round: DataFrame, design: DataFrame) -> DataFrame:
    """Totals of a learning replay per prior precision."""
    n_total = design.agg(F.count(F.lit(1))).scalar()
    return (
        by_round.groupBy("prior_precision")
        .agg(F.sum("n_kept").alias("n_kept"), F.sum("reward").alias("reward"), F.sum("gain").alias("gain"))
        .select(
            "prior_precision",
            n_total.alias("n_total"),
            "n_kept",
            (F.col("n_kept") / F.nullif(n_total, F.lit(0))).alias("kept_share"),
            (F.col("reward") / F.nullif("n_kept", F.lit(0))).alias("conversion_rate"),
            (F.col("gain") / F.nullif("n_kept", F.lit(0))).alias("value_per_contact"),
        )
    )


# -- regret and money ---------------------------------------------------------------------------


def ntile(position: Column, total: Column, parts: int) -> Column:
    """Number of the equal part a zero-based position falls into, larger parts first."""
    size, extra = F.floor(total / parts), total % parts
    head = extra * (size + 1)
    return (
        F.when(position < head, F.floor(position / (size + 1)))
        .otherwise(extra + F.floor((position - head) / F.greatest(size, F.lit(1))))
        .cast("int")
        + 1
    )


def policy_regret(design: DataFrame, scores: Column, policies: Mapping[str, Column], parts: int = 8) -> DataFrame:
    """Value given up by each policy against the best offer of every row.

    ``scores`` states what each offer is worth for a row.  All policies see the
    same rows, which are grouped into consecutive parts of the log.
    """
    total = design.agg(F.count(F.lit(1))).scalar()
    scored = design.select(
        "round_day", "opp_id", scores.alias("__scores"), *[c.alias(f"__{n}") for n, c in policies.items()]
    )
    value_of = lambda offer: F.get(
        F.filter("__scores", lambda s: s["offer_id"] == offer), F.lit(0)
    )["score"]
    named = F.array(
        *[F.struct(F.lit(n).alias("policy"), value_of(F.col(f"__{n}")).alias("chosen_value")) for n in policies]
    )
    # only these few numbers per row are put in order, not the feature vectors
    worth = scored.select(
        "round_day", "opp_id", F.array_max("__scores")["score"].alias("best_value"), named.alias("__values")
    )
    ordered = in_log_order(worth, [], [Measure("__before", F.lit(1).cast("bigint"))])
    return (
        ordered.select(ntile(F.col("__before"), total, parts).alias("part"), "best_value", F.inline("__values"))
        .groupBy("policy", "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("best_value").alias("mean_best_value"),
            F.avg("chosen_value").alias("mean_chosen_value"),
            F.avg(F.col("best_value") - F.col("chosen_value")).alias("mean_regret"),
        )
    )


def historic_value(design: DataFrame) -> DataFrame:
    """What the log itself achieved per contact."""
    return design.agg(
        F.avg("reward").alias("conversion_rate"), F.avg(F.col("reward") * F.col("value")).alias("value_per_contact")
    )


def value_projection(design: DataFrame, summary: DataFrame) -> DataFrame:
    """Money over the whole period: value per contact times all contacts."""
    past = historic_value(design).select(F.lit("historic").alias("policy"), "conversion_rate", "value_per_contact")
    n = design.agg(F.count(F.lit(1))).scalar()
    return past.unionByName(summary.select("policy", "conversion_rate", "value_per_contact")).select(
        "*", n.alias("n_opportunities"), (F.col("value_per_contact") * n).alias("projected_value")
    )


# -- reading the models ---------------------------------------------------------------------------


def weight_table(arms: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per feature and offer."""
    return arms.select("offer_id", F.posexplode("m").alias("__pos", "weight")).select(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("__pos")).alias("feature"), "offer_id", "weight"
    )


def top_weights(arms: DataFrame, names: Sequence[str], k: int = 12) -> DataFrame:
    """Weights of the k features that weigh most for some offer, the bias left out."""
    table = weight_table(arms, names).where(F.col("feature") != "bias")
    leading = (
        table.groupBy("feature")
        .agg(F.max(F.abs("weight")).alias("strength"))
        .orderBy(F.desc("strength"), "feature")
        .limit(k)
    )
    return table.join(leading, "feature")


def weight_pivot(arms: DataFrame, names: Sequence[str], offer_ids: Sequence[str]) -> DataFrame:
    return weight_table(arms, names).groupBy("feature").pivot("offer_id", list(offer_ids)).agg(F.first("weight"))


def example_customers(
    design: DataFrame, scores: Column, offer_types: Mapping[str, str], seed: int = SEED
) -> DataFrame:
    """One telling row per category, all found in the same pass over the rows.

    Draws order rows by a digest of their key; the rest take the first in log order.
    """
    late = exact_quantiles(design, ["raw_customer_tenure_days"], {"q75": 0.75}).select("q75").scalar()
    rows = design.select("*", late.alias("__late"), best_of(scores).alias("__best"))
    kinds = F.create_map(*[F.lit(v) for pair in offer_types.items() for v in pair])
    drawn = F.md5(F.concat_ws("|", "opp_id", F.lit(str(seed))))
    first = F.concat_ws("|", F.lpad(F.col("round_day").cast("string"), 10, "0"), "opp_id")
    best_kind = F.try_element_at(kinds, F.col("__best.offer_id"))
    categories = {
        "long_standing_and_engaged": (
            (F.col("raw_customer_tenure_days") > F.col("__late")) & (F.col("raw_completion_rate_before") > 0.5),
            drawn,
        ),
        "no_purchase_before": (F.col("raw_transaction_count_before") == 0, drawn),
        "most_recent_purchase": (F.lit(True), None),
        "best_is_bogo": (best_kind == "bogo", first),
        "best_is_informational": (best_kind == "informational", first),
    }
    entries = []
    for name, (holds, order) in categories.items():
        lead = F.col("raw_days_since_last_tx") if order is None else F.lit(0.0)
        key = F.struct(
            lead.alias("lead"),
            (F.col("opp_id") if order is None else order).alias("order"),
            F.col("opp_id").alias("opp_id"),
            F.col("__best.offer_id").alias("recommended_offer"),
            F.col("__best.p").alias("p"),
            F.col("__best.score").alias("expected_value"),
        )
        entries.append(
            F.struct(F.lit(name).alias("category"), F.min(F.when(holds, key)).alias("hit")).alias(name)
        )
    return (
        rows.agg(*entries)
        .select(F.inline(F.array(*categories)))
        .where("hit IS NOT NULL")
        .select("category", "hit.opp_id", "hit.recommended_offer", "hit.p", "hit.expected_value")
    )


# -- response models --------------------------------------------------------------------------------


def predicted(design: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """The logged offer's predicted success per row."""
    own = F.filter(map_scores(arms), lambda s: s["offer_id"] == F.col("offer_id"))
    return design.select("opp_id", "offer_id", "reward", F.get(own, F.lit(0))["p"].alias("p"))


def calibration(design: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """Mean prediction against observed rate, per offer."""
    return (
        predicted(design, arms)
        .groupBy("offer_id")
        .agg(F.avg("p").alias("predicted_avg"), F.avg("reward").alias("real_rate"), F.count(F.lit(1)).alias("n"))
    )


def optimality(design: DataFrame, arms: Sequence[Arm], names: Sequence[str]) -> DataFrame:
    """What holds at the optimum of each response model, per offer and feature.

    There the mean of p * x_j, plus the pull of the ridge w_j / n, equals the mean of
    reward * x_j; the right-hand side does not depend on the model.
    """
    pull = F.create_map(*[F.lit(v) for a in arms for v in (a.offer_id, [m * q for m, q in zip(a.m, a.q)])])
    own = F.filter(map_scores(arms), lambda s: s["offer_id"] == F.col("offer_id"))
    each = (
        design.where(F.col("offer_id").isin([a.offer_id for a in arms]))
        .select("offer_id", "reward", F.get(own, F.lit(0))["p"].alias("p"), "x")
        .select("offer_id", "reward", "p", F.posexplode("x").alias("at", "v"))
    )
    means = each.groupBy("offer_id", "at").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("p") * F.col("v")).alias("fitted"), F.avg(F.col("reward") * F.col("v")).alias("observed")
    )
    return means.select(
        "offer_id",
        F.get(F.lit(list(names)), F.col("at")).alias("feature"),
        "n",
        (F.col("fitted") + F.get(F.try_element_at(pull, F.col("offer_id")), F.col("at")) / F.col("n")).alias("fitted"),
        "observed",
    )


def heldout_scores(design: DataFrame, folds: Sequence[tuple]) -> DataFrame:
    """The logged offer's predicted success per row, by models that saw earlier rounds only.

    Rows of the first round have no such model and are left out.
    """
    scores = scores_by_round([(day, SEED, {1.0: arms}) for day, arms in folds], draw=False)
    own = F.filter(scores, lambda s: s["offer_id"] == F.col("offer_id"))
    held_out = design.where(F.col("round_day").isin([day for day, _ in folds]))
    return held_out.select("opp_id", "offer_id", "reward", "round_day", F.get(own, F.lit(0))["p"].alias("p"))


def heldout_optimality(design: DataFrame, folds: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """What holds at the optimum of each fold's models (``optimality``), per fold, offer and feature."""
    found = [
        optimality(
            design.where(F.col("round_day") < day),
            [Arm(a.offer_id, a.value, a.m, (0.0, *a.q[1:])) for a in arms],
            names,
        ).select(F.lit(day).cast("int").alias("fold"), "*")
        for day, arms in folds
    ]
    return reduce(DataFrame.unionByName, found)


def calibration_deciles(design: DataFrame, arms: Sequence[Arm], accuracy: int = 10_000) -> DataFrame:
    """The same per offer and tenth of the predicted score."""
    return by_decile(predicted(design, arms), accuracy)


def by_decile(scored: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Mean prediction against observed rate, per offer and tenth of the predicted score."""
    per_offer = scored.groupBy("offer_id").agg(
        F.percentile_approx("p", [i / 10 for i in range(1, 10)], accuracy).alias("edges")
    )
    # nine numbers per offer: a constant map rather than a join on a ten-valued key
    edges = per_offer.agg(F.map_from_entries(F.collect_list(F.struct("offer_id", "edges")))).scalar()
    own = F.try_element_at(F.col("__edges"), F.col("offer_id"))
    return (
        scored.select("*", edges.alias("__edges"))
        .select("offer_id", "p", "reward", (F.size(F.filter(own, lambda e: e < F.col("p"))) + 1).alias("decile"))
        .groupBy("offer_id", "decile")
        .agg(F.avg("p").alias("predicted_avg"), F.avg("reward").alias("real_rate"), F.count(F.lit(1)).alias("n"))
    )
