"""Posterior of every offer, updated by each micro-batch of outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.operators.posterior import Arm, arms_frame, collect_arms, update_arms


def version_path(table: str, batch_id: int) -> str:
    return f"{table}/version={batch_id}"


def batch_updater(table: str, prior: Sequence[Arm], update_rule: Callable = update_arms) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: read the version before this batch, update it, write this version.

    A batch that is run again overwrites its own version from the same
    predecessor, so the table is right after any restart.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = (
            list(prior) if batch_id == 0 else collect_arms(spark.read.parquet(version_path(table, batch_id - 1)))
        )
        rows = batch.select(F.col("offer_id").alias("model"), "x", "reward").persist()
        try:
            after, _ = update_rule(rows, before)
        finally:
            rows.unpersist()
        arms_frame(spark, after).coalesce(1).write.mode("overwrite").parquet(version_path(table, batch_id))

    return update


def run_updates(
    outcomes: DataFrame, table: str, checkpoint: str, prior: Sequence[Arm], update_rule: Callable = update_arms
) -> None:
    query = (
        outcomes.writeStream.foreachBatch(batch_updater(table, prior, update_rule))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
