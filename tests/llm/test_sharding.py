import math
import zlib
from collections import Counter

import cases
import xxhash
from pyspark.sql import functions as F

from offerscope.llm import sharding


def winner(key, weights):
    """The same law in plain Python, with the hash function's public definition."""
    name = "null" if key is None else str(key)
    first = xxhash.xxh64_intdigest(name.encode(), seed=42)

    def cost(shard):
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=first)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weights[shard]

    return min(range(len(weights)), key=cost)


def test_shards_equal_brute_force(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    found = sharding.shard_records(cases.documents(spark), weights, grown_weight=3.0).collect()
    assert len(found) == len(cases.TEXTS)
    for r in found:
        assert r["shard"] == winner(r["doc_id"], weights)
        assert r["grown_shard"] == winner(r["doc_id"], [*weights, 3.0])
        assert r["grown_shard"] in (r["shard"], 4)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in cases.TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected


def test_slots_have_no_gaps_with_a_key_of_a_third_of_the_rows(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")
    )
    found = sharding.shard_records(docs.repartition(11), [1.0] * 8).collect()
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len(found) == 3000


def test_weights_are_followed_and_few_records_move(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    found = sharding.shard_records(docs, [3.0, 1.0]).groupBy("shard", "grown_shard").count().collect()
    n = {(r["shard"], r["grown_shard"]): r["count"] for r in found}
    assert abs(sum(v for (s, _), v in n.items() if s == 0) / 20_000 - 0.75) < 0.02
    moved = sum(v for (s, g), v in n.items() if s != g)
    assert abs(moved / 20_000 - 0.2) < 0.02 and not any(s != g and g != 2 for s, g in n)


def test_empty_table(spark):
    assert sharding.shard_records(cases.empty(spark), [1.0] * 8).count() == 0
