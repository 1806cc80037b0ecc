"""Streams of files: a source of parquet files and a sink that takes each batch once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Files that a log is cut into for a replay, by time.
REPLAY_FILES = 12
#: Events for each partition of a stateful operator, and its fewest partitions.
STATE_ROWS, LEAST_PARTITIONS = 500_000, 4


def write_log(events: DataFrame, time: str, path: str) -> None:
    """The log as files in order of time; their number, and so that of a replay's batches, does not grow with it."""
    events.repartitionByRange(REPLAY_FILES, time).write.parquet(path)


def state_partitions(spark: SparkSession, path: str) -> int:
    """Partitions of stateful operators for the log in ``path``.

    Every partition of every such operator writes its state stores in every batch, so there are only
    as many as the rows need, whatever number the session uses for batch work.
    """
    return max(LEAST_PARTITIONS, math.ceil(spark.read.parquet(path).count() / STATE_ROWS))


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_files(stream: DataFrame, output: str, checkpoint: str, partitions: int | None = None) -> None:
    """Process everything available and stop; the file sink commits each batch once.

    ``partitions`` of stateful operators are fixed by a checkpoint's first run; the session's by default.
    """
    spark = stream.sparkSession
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        query = writer.start()  # takes its own copy of the settings
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
