import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from offerscope.llm import prefix_trie, queries

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("pos", "digest", "n_bytes", "depth", "a", "_span", "slot", "items")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


def original(rows):
    """conv_id -> turns in order; equal turn numbers go by digest."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            found[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in found.items()}


def rebuilt(convs):
    found = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return found


def brute_force(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    rows = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below[path] if p)
        rows.append(
            (
                min(members),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                children[path],
                sum(children[p] == 0 for p in below[path]),
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


def result(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def run(spark, rows, **options):
    turns, convs = prefix_trie.share_beginnings(prefix_trie.number_turns(table(spark, rows)))
    return result(prefix_trie.prefix_trie(turns, convs, **options))


ODD = [
    (0, None, "user", "first"), (0, 0, "user", "hello"), (0, 1, None, "hi"), (0, 2, "user", None), (0, 2, "user", None),
    (1, 0, "user", "hello"), (2, 0, "user", "hello"), (2, 1, "", "hi"), (2, 1, "b", "tie"), (2, 1, "a", "tie"),
    (3, 5, "user", "ünï"), (4, 0, "user", "hello"), (7, 0, "x", "y"), (9, 0, "x", ""), (9, 1, "x", "long " * 20_000),
    (10, 0, "user", "a"), (11, 0, "usera", ""), (12, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None),
    *[(20, i, "user", f"t{i}") for i in range(40)], *[(21, i, "user", f"t{i}") for i in range(40)],
    *[(22, i, "user", f"t{i % 17}") for i in range(40)], *[(23, i, "user", f"t{i}") for i in range(33)],
    *[(24, i, "user", f"t{i}") for i in range(16)],
]


@pytest.mark.parametrize("block", [8, 3])
def test_odd_conversations_equal_brute_force(spark, block):
    assert run(spark, ODD, block=block) == brute_force(rebuilt(original(ODD)))


def test_growing_logs_and_hot_beginnings(spark, monkeypatch):
    # each conversation logged anew after every turn: chains hang on chains, 45 deep
    rows = [(c * 5, i, "u", f"g{i}") for c in range(45) for i in range(c + 1)]
    # one conversation that a third of all share, one beginning before many ends
    rows += [(1000 + 5 * c, i, "u", f"same {i}") for c in range(60) for i in range(9)]
    rows += [(3000 + 5 * c, i, "u", f"same {i}" if i < 9 else f"{c} {i}") for c in range(60) for i in range(12)]
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    assert run(spark, rows) == brute_force(rebuilt(original(rows)))


def test_the_table_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = result(queries.op11_block_prefix_trie(spark, "/root/testdata/sf0.01"))
    assert found == brute_force(rebuilt(original(rows)))


def test_empty_table(spark):
    assert run(spark, []) == []
