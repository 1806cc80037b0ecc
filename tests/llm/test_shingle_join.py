import random
import re
import tracemalloc

import cases
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from offerscope.llm import components, shingle_join

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text, n=5):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """Components by testing all pairs; (key, set size, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(
        ((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr
    )


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def planted(seed=1):
    """Groups of near copies around the threshold, chains, a shared passage, short texts."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(6, 220))]
        texts += [" ".join(base), " ".join(base).upper()]
        texts += [edited(rng, base, k) for k in (0, 1, 1, 2, 3, 5, 8)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, max(1, len(base) // 60)).split()
            texts.append(" ".join(chain))
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(90)) + " " + passage for _ in range(15)]
    texts += ["a b c", "a b  c", "a b c d", "x", "", "   ", None]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [shingle_join.BLOCK_BYTES, 4096])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK_BYTES", block)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cases.rows(shingle_join.jaccard_components(docs)) == brute(rows)


def test_blocks_grow_with_members_and_let_all_pairs_meet(spark):
    rng = random.Random(6)
    sizes = [100, 110, 140, 3000, 60_000]
    rows = [(7, i, 0, rng.choice(sizes[:2])) for i in range(20_000)]
    rows += [(7, 50_000 + i, 50_000 + i, rng.choice(sizes)) for i in range(12)]
    rows += [(8, i, i % 3, rng.choice(sizes)) for i in range(40)]
    placed = spark.createDataFrame(rows, "tile long, node long, component long, n long")
    # the tool's hot input: a group of near copies and a few others in one tile
    found = shingle_join.block_rows(placed, 75, 100, shingle_join.BLOCK_BYTES).toPandas()
    assert len(found) < 1.2 * len(rows)
    # many blocks: every pair that may link meets in exactly one
    few = [r for r in rows if r[1] % 50 == 0 or r[1] >= 50_000 or r[0] == 8]
    placed = spark.createDataFrame(few, "tile long, node long, component long, n long")
    met = {}
    for _, block in shingle_join.block_rows(placed, 75, 100, 40_000).toPandas().groupby(["tile", "i", "j"]):
        members = block[["node", "side"]].drop_duplicates().values.tolist()
        for x, (a, side_a) in enumerate(members):
            for b, side_b in members[:x]:
                if block.i.iloc[0] == block.j.iloc[0] or side_a != side_b:
                    pair = (int(block.tile.iloc[0]), min(a, b), max(a, b))
                    met[pair] = met.get(pair, 0) + 1
    for x, (t, a, c, m) in enumerate(few):
        for u, b, d, k in few[:x]:
            if t == u and c != d and 100 * min(m, k) >= 75 * max(m, k):
                assert met[t, min(a, b), max(a, b)] == 1


def test_long_near_copies_in_bounded_memory():
    # 600 classes of 60,000 shingles: maps of 64 KB each, two blocks of 4 MB at a time
    rng = np.random.default_rng(8)
    n, log_bits = 60_000, shingle_join.bits_for(60_000)
    count = 2 * shingle_join.BLOCK_BYTES // (2 * n)
    maps = [rng.integers(0, 256, (1 << log_bits) // 8, dtype=np.uint8).tobytes() for _ in range(count)]
    columns = {
        "tile": [1] * count, "i": [0] * count, "j": [1] * count, "node": range(count), "side": [i % 2 for i in range(count)],
        "component": range(count), "now": range(count), "n": [n] * count, "bits": maps, "tiles": [[1, 2]] * count,
    }
    batch = pa.RecordBatch.from_pydict({k: pa.array(list(v)) for k, v in columns.items()})
    tracemalloc.start()
    list(shingle_join._bound(75, 100, 2)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 8 * shingle_join.BLOCK_BYTES
    tracemalloc.stop()


def test_the_smallest_of_equal_rows_stays(spark):
    rows = [(1, "a b c d e f", "z", {"k": 1}), (1, "a b c d e f", "b", {"k": 2}), (1, "a b c d e f", "b", {"k": 1}), (2, "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _hash map<string,int>").repartition(4)
    kept = sorted(map(tuple, shingle_join.one_per_component(docs).collect()))
    assert kept == [rows[2], rows[3]]


def test_odd_rows(spark):
    found = cases.rows(shingle_join.jaccard_components(cases.documents(spark)))
    assert found == brute([(i, t) for i, t, _, _ in cases.TEXTS])
    assert shingle_join.jaccard_components(cases.empty(spark)).count() == 0


def test_table_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    found = cases.rows(shingle_join.jaccard_components(spark.read.parquet(f"{SF_DIR}/documents.parquet")))
    assert found == brute(list(zip(docs.doc_id.tolist(), docs.text.tolist())))


def test_one_stays_of_each_group(spark):
    docs = cases.documents(spark)
    kept = shingle_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(size * rng.random() * 0.2)).astype(np.uint64)]))
        if len(b) < 2:
            continue
        log_bits = shingle_join.bits_for(min(len(a), len(b)))
        x, y = (shingle_join.fold(shingle_join.bitmap(s, shingle_join.bits_for(len(s))), log_bits) if shingle_join.bits_for(len(s)) != log_bits else shingle_join.bitmap(s, log_bits) for s in (a, b))
        bound = (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2
        assert len(np.intersect1d(a, b)) <= bound


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    found = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}, **{2000 + i: 2000 for i in range(50)}}
    assert components.components(df.limit(0)).count() == 0


def test_tiles_of_different_classes_are_kept_apart(spark):
    """Pairs of nodes whose sums of 40 bits of one hash agree are still two tiles."""
    hashed = spark.range(4000).select(F.xxhash64("id") % (1 << 40)).collect()
    short = np.array([r[0] for r in hashed])
    a, b = np.triu_indices(len(short), 1)
    sums = short[a] + short[b]
    order = np.argsort(sums)
    same = np.flatnonzero(np.diff(sums[order]) == 0)
    assert len(same)
    for k in same[:5]:
        pairs = [(tile, int(node)) for tile, at in enumerate(order[k : k + 2]) for node in (a[at], b[at])]
        twice = [(2, node) for tile, node in pairs if tile == 0]
        placed = spark.createDataFrame(pairs + twice, "tile long, node long").withColumn("component", F.col("node"))
        assert sorted(map(tuple, shingle_join.distinct_tiles(placed).collect())) == [(0, 2), (1, 2)]
