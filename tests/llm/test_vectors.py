import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerscope.llm import neardup, topk
from offerscope.llm.components import roots

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, node int, bucket int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, 0, 0, 0, 0) for i, v, g in rows], SCHEMA)


def clustered(seed=3, n=400, size=24):
    """Random vectors with tight groups, copies, and two labels."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, size)).astype(np.float32)
    for i in range(0, n, 4):
        x[i + 1] = x[i]
        x[i + 2] = x[i] + rng.normal(0, rng.uniform(0.02, 0.25), size)
    x[n // 2 :: 7] = x[5] + rng.normal(0, 0.05, (len(x[n // 2 :: 7]), size))
    return [(3 * i, x[i].tolist(), int(i % 8 < 6)) for i in range(n)]


ODD = [
    (-1, None, 1), (-2, [], 1), (-3, [0.0] * 24, 1), (-4, [NAN] + [1.0] * 23, 1), (-5, [INF] + [1.0] * 23, 1),
    (-6, [None] + [1.0] * 23, 1), (-7, [1.0] * 24, None), (-8, [1.0] * 24, 1), (-8, [1.0] * 24, 1), (-9, [2.0] * 24, 1),
    (-10, [1.0, 2.0], 1), (None, [1.0] * 24, 1),
]


def usable(v, g):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) and g is not None


def brute_links(rows):
    n = len(rows)
    pairs = []
    fit = [usable(v, g) for _, v, g in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if f else None for (_, v, _), f in zip(rows, fit)]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                pairs.append((j, i))
    a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    links = np.bincount(np.r_[a, b], minlength=n)
    root = roots(n, a, b)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    component = [least.get(root[i]) if fit[i] else rows[i][0] for i in range(n)]
    return sorted(((rows[i][0], int(links[i]), component[i], rows[i][0] == component[i] if component[i] is not None and rows[i][0] is not None else False) for i in range(n)), key=repr)


@pytest.mark.parametrize("block,bucket", [(neardup.BLOCK, neardup.BUCKET), (8, 20)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, bucket):
    """All links are found here, with one rotation per hash and with more."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rows = clustered() + ODD
    found = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    expected = brute_links(rows)
    total = sum(r[1] for r in expected)
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert all(a[1] <= b[1] for a, b in zip(found, expected))
    assert sum(r[1] for r in found) >= 0.98 * total > 0
    if bucket == neardup.BUCKET:
        assert found == expected


def test_recall_at_the_threshold():
    """Pairs at cosine 0.98 exactly, in 64 dimensions: the share that shares a bucket."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(0, 1, (4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for turns, tables in neardup.TABLES.items():
        hashing = neardup.CrossPolytope(64, tables, turns)
        a, b = hashing.buckets(x), hashing.buckets(y)
        recall = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean()
        assert recall > (0.999 if turns == 1 else 0.9), (turns, recall)


def test_hadamard_equals_its_matrix():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(0, 1, (5, 16))
    assert np.allclose(neardup.hadamard(x), x @ h)


def brute_top(rows, k, is_query):
    fit = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fit):
        if is_query(i):
            scores = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(fit) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [topk.BUCKET, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rows = clustered(n=200) + [r for r in ODD if r[0] != -10] + [(i * 10_000, (np.array(v) * s).tolist(), 0) for i, (v, s) in enumerate([(clustered()[9][1], 9.0), (clustered()[11][1], 30.0)], 1)]
    docs = frame(spark, rows).select("vec_id", topk.whole_numbers(F.col("embedding"), 1024).alias("vector"))
    found = sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 20 == 0, 5).collect())
    assert found == brute_top(rows, 5, lambda i: i % 20 == 0)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [3.0, 0.5], 1)]
    docs = frame(spark, rows).select("vec_id", topk.whole_numbers(F.col("embedding"), 1024).alias("vector"))
    assert sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") == 0).collect()) == brute_top(rows, 10, lambda i: i == 0)
    assert topk.top_k(docs.limit(0), F.col("vec_id") == 0).count() == 0


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert {tuple(r) for r in neardup.near_duplicates(frame(spark, [(1, None, 1), (2, [1.0], None)])).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
