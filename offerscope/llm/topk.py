"""Exact top-k by inner product, by norm-bucketed retrieval.

1. Candidates are range-partitioned by length (longest first); each partition is a bucket.
   Queries are dealt into blocks.
2. Every query meets the first bucket, the one of the longest vectors; the k-th best score
   there is its first threshold.
3. Every query block meets every other bucket.  With threshold t, query length |q| and
   longest vector l of the bucket, a candidate must reach the cosine t / (|q| l).  Above 1
   the bucket is skipped.  Where the local threshold is high, coordinate pruning applies: the
   largest coordinates of the query are multiplied first, and Cauchy-Schwarz bounds the rest
   from above.  Where it is low, only lengths prune: candidates shorter than t / |q| go.
   What is left is verified by whole products, and the threshold rises from batch to batch.
4. The best k of all buckets are the result.

Components are whole numbers, so products are exact (in double precision, below 2^53; the
operator checks that).  Pruning removes only scores strictly below the threshold; ties go
to the smaller id.  Each work item is one block of queries and one bucket, both of
bounded size; queries are a stated set, compared with all rows in blocks.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, nor do rows with a null id; vectors of another length do not meet; a query
never meets its own row, but repeated rows do meet each other: only one row of its id is left
out; fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.shingle_join import sorted_groups
from offerscope.session import stage

BUCKET = 1024
QUERIES = 256
#: Local cosine threshold from which coordinates prune better than lengths.
STEEP = 0.3
#: Coordinates of a query that are multiplied first.
FOCUS = 12
EXACT = float(1 << 53)


def local_best(
    q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, q_own: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of up to k candidates of a bucket per query.

    ``least``: a score that the k-th best of the whole result reaches at least.
    """
    lengths = np.sqrt((x * x).sum(1))
    order = np.argsort(-lengths, kind="stable")
    x, ids, own, lengths = x[order], ids[order], own[order], lengths[order]
    q_lengths = np.sqrt((q * q).sum(1))
    out_q, out_x, out_s = [], [], []
    for i in range(len(q)):
        most = q_lengths[i] * lengths[0]
        bar = least[i]
        if bar > most * (1 + 1e-12):
            continue  # the local threshold is above 1: no vector of the bucket can reach it
        steep = most > 0 and bar / most >= STEEP
        if steep:
            focus = np.argpartition(-np.abs(q[i]), min(FOCUS, q.shape[1] - 1))[:FOCUS]
            part = x[:, focus]
            near = part @ q[i, focus]
            rest = np.sqrt(np.maximum(lengths**2 - (part * part).sum(1), 0))
            q_rest = np.sqrt(max(q_lengths[i] ** 2 - float((q[i, focus] ** 2).sum()), 0.0))
            left = np.flatnonzero(near + rest * q_rest * (1 + 1e-12) + 1e-6 >= bar)
        elif bar > 0 and q_lengths[i] > 0:
            left = np.arange(np.searchsorted(-lengths, -bar / q_lengths[i] * (1 - 1e-12), "right"))
        else:
            left = np.arange(len(x))
        left = left[own[left] != q_own[i]]
        score = x[left] @ q[i]
        good = score >= bar
        left, score = left[good], score[good]
        best = np.lexsort((ids[left], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_x.append(order[left[best]])
        out_s.append(score[best])
    if not out_q:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def _meet(k: int):
    """Sorted rows of bucket, block, dims, is_query, id, row, vector, least -> query row and id, candidate id, score."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            get = lambda name: group.column(name).to_numpy()
            asked = get("is_query")
            if not asked.any() or asked.all():
                continue
            flat = group.column("vector").combine_chunks()
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(group.num_rows, -1)
            ids, rows, least = get("id"), get("row"), get("least")
            if np.abs(x).max(initial=0) ** 2 * x.shape[1] >= EXACT:
                raise ValueError("components are too large for exact products")
            q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
            a, b, score = local_best(ids[q], x[q], least[q], ids[c], x[c], rows[c], rows[q], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[q][a]), pa.array(ids[q][a]), pa.array(ids[c][b]), pa.array(score.astype(np.int64))],
                names=["query_row", "query_id", "vec_id", "score"],
            )

    return meet


MET = "query_row long, query_id long, vec_id long, score long"
WORK = ["bucket", "block", "dims"]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component in double precision; null unless all are finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(
        (F.size(x) > 0) & F.coalesce(fine, F.lit(False)),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")),
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query``, its ``k`` best other rows.

    ``vector``: an array of whole numbers.
    """
    rows = stage(
        vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
            F.col(key).cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.col(vector).alias("vector"),
            F.size(vector).alias("dims"),
            F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)).alias("length"),
            is_query.alias("is_query"),
        ),
        "topk-rows",
    )
    n = rows.count()
    buckets = max(1, -(-n // BUCKET))
    candidates = stage(
        rows.repartitionByRange(buckets, F.desc("length"), "row").withColumn("bucket", F.spark_partition_id()),
        "topk-buckets",
    )
    queries = rows.filter("is_query").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // (BUCKET * 16))))).cast("int")
    )
    shape = candidates.groupBy("bucket", "dims").agg(F.max("length").alias("longest"))
    blocks = queries.select("block", "dims").distinct()

    def met(asked: DataFrame, where: Column) -> DataFrame:
        pairs = shape.filter(where).join(blocks, "dims").select(*WORK)
        ask = asked.join(shape.filter(where).select("bucket", "dims"), "dims").select(
            *WORK, F.lit(True).alias("is_query"), "id", "row", "vector", "least"
        )
        offer = candidates.join(pairs, ["bucket", "dims"]).select(
            *WORK, F.lit(False).alias("is_query"), "id", "row", "vector", F.lit(0.0).alias("least")
        )
        return (
            ask.unionByName(offer)
            .repartition(*WORK)
            .sortWithinPartitions(*WORK)
            .mapInArrow(_meet(k), MET)
        )

    lowest = F.lit(-EXACT)
    first = stage(met(queries.withColumn("least", lowest), F.col("bucket") == 0), "topk-first")
    bars = (
        _best(first, k)
        .groupBy("query_row")
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        .filter(F.col("n") == k)
        .select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("least"))
    )
    asked = queries.join(bars, "row", "left").withColumn("least", F.coalesce("least", lowest))
    others = met(asked, F.col("bucket") > 0)
    return _best(first.unionByName(others), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
