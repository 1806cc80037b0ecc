"""JSON in, parquet out and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.sources import schemas


def read_json(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """Read JSON lines against a declared schema.

    Lines that do not parse are kept as null rows, or with their text in
    ``_corrupt_record`` if ``keep_corrupt`` is set, so no line is lost unseen.
    """
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(schemas.CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path)


def read_quarantined(spark: SparkSession, path: str, schema: T.StructType, into: str) -> tuple[DataFrame, DataFrame]:
    """The lines that parse, and those that do not: file, text and what of it could be read, written to ``into``.

    Bad lines are set aside in one pass and read back from ``into``, so that they can be counted
    and mended without reading the source again.
    """
    whole = read_json(spark, path, schema, keep_corrupt=True)
    broken = F.col(schemas.CORRUPT).isNotNull()
    read = F.to_json(F.struct(*schema.names))  # the parser refuses to give the text of bad lines alone
    bad = whole.where(broken).select(F.input_file_name().alias("file"), F.col(schemas.CORRUPT).alias("line"), read.alias("read"))
    bad.write.mode("overwrite").parquet(into)
    return whole.where(~broken).drop(schemas.CORRUPT), spark.read.schema("file string, line string, read string").parquet(into)


@dataclass(frozen=True)
class RawTables:
    offers: DataFrame
    profile: DataFrame
    transactions: DataFrame


def read_raw(spark: SparkSession, folder: str, quarantine: str | None = None) -> RawTables:
    """The three inputs.  With a ``quarantine`` folder, lines that do not parse go there; without, they
    are null rows."""
    found = {}
    for name, schema in (("offers", schemas.OFFERS), ("profile", schemas.PROFILE), ("transactions", schemas.TRANSACTIONS)):
        path = f"{folder}/{name}.json"
        found[name] = (
            read_quarantined(spark, path, schema, f"{quarantine}/{name}")[0] if quarantine else read_json(spark, path, schema)
        )
    return RawTables(**found)


def write_raw(raw: RawTables, folder: str) -> None:
    """The raw tables as JSON lines, as ``read_raw`` takes them; null fields are left out."""
    for name in ("offers", "profile", "transactions"):
        getattr(raw, name).write.json(f"{folder}/{name}.json")


def write_opportunities(
    opps: DataFrame, path: str, partition_by: str = "round_day", observation: Observation | None = None
) -> None:
    """Overwrite the opportunity table, one folder per send round.

    The rebalance lets adaptive execution cut a large round into several files
    and keeps a small one from becoming one file per task.  ``observation``
    receives the row count ``n``; it sits behind the last exchange, where a task
    that is run again after an executor loss is not counted twice.
    """
    out = opps.hint("rebalance", partition_by)
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("n"))
    out.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def update_opportunities(path: str, events: DataFrame, since: float, build: Callable[[DataFrame], DataFrame]) -> None:
    """Bring a stored opportunity table up to date with events that arrived from time ``since`` on.

    ``events`` is the whole log and ``build`` makes opportunities of a log.  Only rounds with a
    window that is still open at ``since``, and new ones, are made anew, from the events since the first
    of their sends; only their folders are overwritten.
    """
    spark = events.sparkSession
    stored = read_opportunities(spark, path)
    # a send without a window (unknown offer) never has an outcome; a round is open by its last window
    of_round = stored.groupBy("round_day").agg(F.max("t_expires").alias("end"), F.min("t_received").alias("start"))
    first = of_round.where(F.col("end") >= since).agg(F.min("start")).first()[0]
    start = min(x for x in (first, since) if x is not None)
    fresh = build(events.where(F.col("time_since_test_start") >= start))
    closed = of_round.where(F.col("end") < since).select("round_day")
    changed = fresh.join(closed, "round_day", "left_anti").select(*fresh.columns)
    changed.hint("rebalance", "round_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "round_day"
    ).parquet(path)


def read_opportunities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verified_write(opps: DataFrame, path: str, partition_by: str = "round_day") -> DataFrame:
    """Write, read back, and accept the files only if no row went missing.

    The expected count is taken while writing, so the plan behind ``opps`` runs
    once.
    """
    seen = Observation()
    write_opportunities(opps, path, partition_by, seen)
    stored = read_opportunities(opps.sparkSession, path)
    n_stored = stored.count()
    if n_stored != seen.get["n"]:
        raise RuntimeError(f"{path}: wrote {seen.get['n']} rows but {n_stored} read back")
    return stored
