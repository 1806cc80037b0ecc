"""Session settings and tables staged between the steps of a multi-pass job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job here relies on.  Partition counts are left to the
#: cluster's own configuration; adaptive execution merges and splits from there.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot customer's events must be split even if that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Settings that only help before the first query: no call-site capture per column.
STARTUP_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "offerscope", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **STARTUP_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as named by ``spark.checkpoint.dir``.

    A folder of this machine is made up only for a local master, where every
    task can see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="offerscope-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Rows of a file of a table that is read one partition value at a time.
FILE_ROWS = 50_000

_STAGED: list[str] = []


def new_staging_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; ``release_staged`` deletes it."""
    path = f"{staging_root(spark)}/offerscope/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rebalance: bool = True, file_rows: int = 0
) -> DataFrame:
    """Write ``df`` once and read it back, so later passes scan columns, not the plan.

    The files survive the loss of executors.  With ``partition_by`` a rebalance
    splits large partition values over several files and merges small ones; it
    is not worth its shuffle for a column of a handful of values, or if ``df`` reads a
    table laid out in the same way.  ``file_rows`` bounds the rows of a file (0: no bound), so
    that a scan of one partition value has as many tasks as it has such parts.
    """
    spark = df.sparkSession
    path = new_staging_path(spark, name)
    laid_out = df.hint("rebalance", *partition_by) if partition_by and rebalance else df
    laid_out.write.option("maxRecordsPerFile", file_rows).partitionBy(*partition_by).parquet(path)
    columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
    staged = spark.read.schema(df.select(*columns).schema).parquet(path).select(*df.columns)
    staged._staged_path = path
    return staged


def _delete(spark: SparkSession, path: str) -> int:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True))


def unstage(*frames: DataFrame) -> None:
    """Delete tables that ``stage`` returned and that nothing will read again."""
    for df in frames:
        if df._staged_path in _STAGED:
            _STAGED.remove(df._staged_path)
            _delete(df.sparkSession, df._staged_path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of frames that are out of reach go when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this process staged; returns how many.  Frames that read them are then void."""
    count = 0
    while _STAGED:
        count += _delete(spark, _STAGED.pop())
    return count
