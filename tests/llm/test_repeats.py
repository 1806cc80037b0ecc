import hashlib
import random

import cases
import numpy as np
import pytest

from offerscope.llm import queries, repeats


def brute_force(docs, length=100):
    """Rows of (key, text) -> (key, n_bytes, n_removed, n_spans, kept); rows of a key share places."""
    order = lambda k: (k is not None, k or 0)
    data = [(k, (t or "").encode()) for k, t in docs]
    first = {}
    for k, t in data:
        for i in range(len(t) - length + 1):
            place = (order(k), i)
            s = t[i : i + length]
            if s not in first or place < first[s]:
                first[s] = place
    rows = []
    for k, t in data:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (order(k), i):
                gone[i + 1 : i + 1 + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]]) if t else b""
        rows.append((k, len(t), len(t) - len(left), int((gone[1:] & ~gone[:-1]).sum()), left))
    return sorted(rows, key=repr)


def found(docs_frame, **options):
    rows = repeats.without_repeats(docs_frame, **options).collect()
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows), key=repr)


def pages(seed, n=60):
    """Texts of shared passages of many lengths, cut and joined at random, and periodic text."""
    rng = random.Random(seed)
    letters = "ab " if seed % 2 else "abcdefghijklmnopqrstuvwxyz \u00e9"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 700))) for _ in range(12)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += rng.choice([p, p[a:], p[:a], "".join(rng.choice(letters) for _ in range(rng.randrange(300)))])
        if i % 9 == 0:
            text += rng.choice(["x", "xy", "abc"]) * rng.randrange(200)
        docs.append((rng.choice([i, i, i, None, 3]), rng.choice([text, text, text, None]) if i else None))
    return docs + docs[:3]


@pytest.mark.parametrize(("seed", "many"), [(1, 2), (2, 1000), (3, 4), (5, 1000)])
def test_documents_equal_brute_force(spark, seed, many, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "GROUP", 30)
    monkeypatch.setattr(repeats, "MANY", many)
    docs = pages(seed)
    frame = cases.documents(spark, [(k, t, None, None) for k, t in docs]).repartition(5)
    assert found(frame) == brute_force(docs)


def test_other_lengths(spark):
    docs = pages(4, 30)
    frame = cases.documents(spark, [(k, t, None, None) for k, t in docs])
    assert found(frame, length=40, window=7) == brute_force(docs, 40)


def test_odd_documents_and_extra_columns(spark):
    docs = [(i, t) for i, t, _, _ in cases.TEXTS]
    assert found(cases.documents(spark)) == brute_force(docs)
    assert found(cases.empty(spark)) == []


def test_suffixes_are_in_order():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 3000, dtype=np.uint8)
    starts = np.arange(len(data) - 7)
    order, new = repeats.suffix_array(data, starts, 8)
    strings = [bytes(data[s : s + 8]) for s in starts]
    assert order.tolist() == sorted(range(len(strings)), key=lambda i: (strings[i], i))
    assert new.sum() == len(set(strings))


def test_a_passage_with_other_surroundings_in_each_document(spark):
    # one trigger, one string or a few, and as many phrases as documents
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = word(103)
    docs = [(i, word(120) + passage + word(120)) for i in range(150)]
    rows = found(cases.documents(spark, [(k, t, None, None) for k, t in docs]))
    assert rows == brute_force(docs) and sum(r[2] >= 103 for r in rows) == 149


def test_equal_strings_have_equal_triggers():
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 4, 100, dtype=np.uint8)
    seen = set()
    for _ in range(50):
        data = np.concatenate([rng.integers(0, 4, rng.integers(0, 300), dtype=np.uint8), inner, rng.integers(0, 4, 200, dtype=np.uint8)])
        at = len(data) - 300
        t, _, first, n, _ = repeats.parse(data, np.array([len(data)]), 100, 36, True)
        assert n.sum() == len(data) - 99
        seen.add(int(t[np.searchsorted(first, at, "right") - 1]))
    assert len(seen) == 1


def test_the_table_equals_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    expected = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_force([tuple(d) for d in docs])]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = queries.op13_prefix_free_dedup(spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(expected, key=repr)
