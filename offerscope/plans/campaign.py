"""The tables of one campaign, each built when first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.functions.columns import GENDERS
from offerscope.operators import attribution, cleaning, features, metrics, policies, posterior, quality
from offerscope.session import FILE_ROWS, stage, tune
from offerscope.sources import files, fixtures


class Campaign:
    """Raw inputs and everything derived from them.

    Tables are lazy plans.  Only those that several passes read are staged as
    parquet: the flat events (so that raw text is parsed once, and a scan of one
    kind of event reads only that kind), the context table and the design rows.
    """

    def __init__(self, raw: files.RawTables, hot_rows: int = attribution.HOT_ROWS):
        self.raw = raw
        self.hot_rows = hot_rows

    @classmethod
    def from_parquet(cls, spark: SparkSession, sf_dir: str, **options) -> Campaign:
        return cls(fixtures.raw_tables(tune(spark), sf_dir), **options)

    @classmethod
    def from_json(cls, spark: SparkSession, folder: str, **options) -> Campaign:
        return cls(files.read_raw(tune(spark), folder), **options)

    @cached_property
    def offers(self) -> DataFrame:
        return cleaning.small_dimension(self.raw.offers)

    @cached_property
    def profile(self) -> DataFrame:
        return cleaning.clean_profile(self.raw.profile)

    @cached_property
    def events(self) -> DataFrame:
        return cleaning.flatten_transactions(self.raw.transactions)

    @cached_property
    def log(self) -> DataFrame:
        return cleaning.event_log(self.events, self.profile, self.offers)

    @cached_property
    def staged_events(self) -> DataFrame:
        # sorted inside each task, so that the files' statistics prune kinds of events
        return stage(self.events.sortWithinPartitions("event"), "events")

    @cached_property
    def hot(self) -> list[int]:
        return attribution.hot_customers(self.staged_events, self.hot_rows)

    @cached_property
    def opps(self) -> DataFrame:
        return attribution.opportunities(self.staged_events, self.offers, self.profile, self.hot)

    @cached_property
    def contexts(self) -> DataFrame:
        return features.context_features(self.opps, self.staged_events, self.profile, hot=self.hot)

    @cached_property
    def staged_contexts(self) -> DataFrame:
        return stage(self.contexts, "contexts", ("round_day",), file_rows=FILE_ROWS)

    @cached_property
    def n_features(self) -> int:
        numeric, _ = features.feature_columns(self.staged_contexts)
        return 1 + len(numeric) + len(GENDERS)

    @cached_property
    def feature_names(self) -> list[str]:
        return features.design_names(self.staged_contexts)

    @cached_property
    def arm_values(self) -> DataFrame:
        return policies.arm_values(self.offers, self.staged_events, self.opps)

    @cached_property
    def value_list(self) -> list[posterior.Arm]:
        # the staged contexts carry all the opportunity columns that matter here
        return posterior.collect_arms(policies.arm_values(self.offers, self.staged_events, self.staged_contexts))

    @cached_property
    def values(self) -> dict[str, float]:
        return {a.offer_id: a.value for a in self.value_list}

    @cached_property
    def design(self) -> DataFrame:
        """Design rows with the value of a success of the logged offer, staged by round."""
        numeric, _ = features.feature_columns(self.staged_contexts)
        quality.require_no_nulls(self.staged_contexts, numeric)
        rows = features.design_matrix(self.staged_contexts, keep=policies.EXAMPLE_COLUMNS)
        # the contexts are laid out by round already, in files small enough to be read by many tasks
        valued = policies.with_values(rows, self.values)
        return stage(valued, "design", ("round_day",), rebalance=False, file_rows=FILE_ROWS)

    @cached_property
    def arms(self) -> list[posterior.Arm]:
        """Posterior of every offer after one closed-form step, a check of the formulas only."""
        return posterior.first_step(self.design, self.values, self.n_features)

    @property
    def arms_table(self) -> DataFrame:
        return posterior.arms_frame(self.offers.sparkSession, self.arms)

    @cached_property
    def learning(self) -> tuple[DataFrame, list[posterior.Arm], list[tuple]]:
        """The learning replay: its rounds, its final arms, and the arms each round was chosen with."""
        history: list[tuple] = []
        by_round, arms = policies.thompson_replay(self.design, self.values, self.n_features, history=history)
        return by_round, arms[1.0], history

    @cached_property
    def diagonal(self) -> tuple[DataFrame, list[posterior.Arm], list[tuple]]:
        """The learning replay by diagonal steps: its rounds, final arms, and the arms each round was chosen with."""
        history: list[tuple] = []
        by_round, arms = policies.thompson_replay(
            self.design, self.values, self.n_features, history=history, update=posterior.diagonal_update
        )
        return by_round, arms[1.0], history

    @property
    def diagonal_arms(self) -> list[posterior.Arm]:
        return self.diagonal[1]

    @property
    def diagonal_table(self) -> DataFrame:
        return posterior.arms_frame(self.offers.sparkSession, self.diagonal_arms)

    @property
    def trained_arms(self) -> list[posterior.Arm]:
        return self.learning[1]

    @property
    def trained_table(self) -> DataFrame:
        return posterior.arms_frame(self.offers.sparkSession, self.trained_arms)

    @cached_property
    def response_models(self) -> list[posterior.Arm]:
        return posterior.fit_response_models(self.design, self.values, self.n_features)

    @cached_property
    def heldout_models(self) -> list[tuple]:
        return posterior.fit_heldout(self.design, self.values, self.n_features)

    @cached_property
    def best_by_rate(self) -> str:
        return metrics.best_offer(self.design).first()["offer_id"]

    @cached_property
    def offer_types(self) -> dict[str, str]:
        rows = self.offers.select("id", "offer_type").limit(posterior.MAX_MODELS + 1).collect()
        if len(rows) > posterior.MAX_MODELS:
            raise ValueError(f"more than {posterior.MAX_MODELS} offers")
        return {r["id"]: r["offer_type"] for r in rows}

    def policies(self, diagonal: bool = False) -> dict:
        """What is compared.  The policies that learn choose each round with arms that saw earlier rounds only."""
        history = (self.diagonal if diagonal else self.learning)[2]
        return {
            "random": policies.random_offer(list(self.values)),
            "fixed": F.lit(self.best_by_rate),
            "greedy": policies.best_of(policies.scores_by_round(history, draw=False))["offer_id"],
            "thompson": policies.best_of(policies.scores_by_round(history))["offer_id"],
        }

    def step_policies(self) -> dict:
        """The same names with the closed-form arms, which saw all rounds: for checks of the formulas."""
        map_scores = policies.map_scores(self.arms)
        return {
            "random": policies.random_offer(list(self.values)),
            "fixed": F.lit(self.best_by_rate),
            "greedy": policies.best_of(map_scores)["offer_id"],
            "thompson": policies.best_of(policies.thompson_scores(self.arms))["offer_id"],
        }
