"""Rendezvous (highest-random-weight) sharding of stable record keys over weighted shards.

A record goes to the shard with the smallest ``-ln(u) / weight``, where ``u`` is a hash of
(key, shard) in (0, 1).  Only the key, the shards and their weights decide.  A further
shard can only take records that it wins; nothing moves between the old ones.

Slots number the records of a shard without gaps: rows are range-partitioned by
(shard, key, ...), numbered inside their partition, and shifted by the rows of earlier
partitions, so that no window runs over a whole shard.

Defined results: a null key is the key ``null`` and all its rows share a shard; a null text
has no bytes (size 1, checksum 0); repeated rows each get a slot of their own; equal
(shard, key, checksum, size) rows get neighbouring slots in either order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.session import stage

#: Low bits of monotonically_increasing_id: the row's number inside its partition.
WITHIN_PARTITION = (1 << 33) - 1


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) that wins ``key``; ties go to the smaller number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    stable = F.coalesce(key.cast("string"), F.lit("null"))
    bids = []
    for shard, weight in enumerate(weights):
        # 53 hash bits, so that u is an exact double strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(stable, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        bids.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def number_slots(rows: DataFrame, group: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Add a gapless number from 0 inside each ``group``, in the order of ``order``."""
    fixed = stage(rows.withColumn("_uid", F.monotonically_increasing_id()), "slots-in")
    ranged = fixed.repartitionByRange(group, *order, "_uid").sortWithinPartitions(group, *order, "_uid")
    placed = stage(
        ranged.drop("_uid").withColumn("_part", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id().bitwiseAND(WITHIN_PARTITION)
        ),
        "slots-ranged",
    )
    # one row per partition and shard in it
    runs = placed.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        "_part", group, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    numbered = placed.join(shifts, ["_part", group])
    return numbered.withColumn(slot, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot, and grown_shard, its shard
    after one more shard of ``grown_weight`` is added."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    return number_slots(rows, "shard", [key, "text_crc32", "size"])
