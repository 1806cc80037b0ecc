import hashlib
import random
import re
import zlib

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerscope.llm import queries, runs


def brute_runs(w, least=6, power=4):
    """(start, length, period) straight from the definition: maximal stretches of every period."""
    found, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, rewrite):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    decimal = b"" if doc_id is None else str(doc_id).encode()
    h = zlib.crc32(decimal)
    n = len(words)
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def in_tiles(w, whole):
    """The runs as the tasks of a long text find them."""
    parts = []
    for low, high, a, b in runs.tile_bounds(len(w), whole):
        found = runs.solve(w[a:b].astype(np.int32), high, open_=True)
        found = found[found[:, 0] >= low]
        parts.append(found + [0, a, a])
    return [tuple(r) for r in runs.runs_of(np.concatenate(parts), 6, 4).tolist()]


def at_once(texts):
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate([np.r_[t, -1 - i] for i, t in enumerate(texts)]).astype(np.int64)
    found = runs.runs_of(runs.solve(flat, int(lengths.max()) // 4, lengths=lengths), 6, 4)
    starts = np.r_[0, np.cumsum(lengths + 1)]
    return [[(s - a, m, q) for s, m, q in found.tolist() if a <= s < b] for a, b in zip(starts, starts[1:])]


def made_of_repeats(rng, n, letters):
    w = []
    while len(w) < n:
        q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40, 64, 100])
        part = [rng.randrange(letters) for _ in range(q)]
        w += (part * rng.randrange(1, 9))[: rng.randrange(1, 8 * q + 1)]
        if rng.random() < 0.3:
            w += w[-rng.randrange(1, 60) :] * rng.randrange(1, 5)
    return np.array(w[:n])


def test_texts_side_by_side_and_tiles_equal_the_definition():
    rng = random.Random(5)
    for _ in range(60):
        texts = [made_of_repeats(rng, rng.randrange(1, 900), rng.choice([1, 2, 3, 50])) for _ in range(5)]
        expected = [brute_runs(t.tolist()) for t in texts]
        assert at_once(texts) == expected
        for t, runs_ in zip(texts, expected):
            assert in_tiles(t, 128) == runs_


def test_no_runs_in_a_word_without_fourth_powers():
    thue_morse = np.array([bin(i).count("1") % 2 for i in range(5000)])
    assert at_once([thue_morse]) == [[]] and in_tiles(thue_morse, 128) == []


def test_one_word_repeated_and_one_long_period():
    n = 20_000
    same = np.zeros(n, np.int64)
    assert at_once([same]) == [[(0, n, 1)]] and in_tiles(same, 256) == [(0, n, 1)]
    rng = np.random.default_rng(1)
    period = np.tile(rng.integers(0, 1 << 30, 4999), 5)[:n]
    assert at_once([period]) == [[(0, n, 4999)]] and in_tiles(period, 256) == [(0, n, 4999)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=60), min_size=1, max_size=4), st.integers(1, 8))
def test_any_words(parts, times):
    texts = [np.array(p * times) for p in parts]
    assert at_once(texts) == [brute_runs(t.tolist()) for t in texts]


PERIODIC = [
    (20, "a b c " * 30, None, None),
    (21, "x " * 6, None, None),
    (22, "x " * 5, None, None),
    (23, "Ä\x0bÄ\x0cÄ\tÄ\nÄ\rÄ Ä\x1cb", None, None),
    (24, " ".join(f"w{i % 211}" for i in range(2000)), None, None),
    *[(100 + i, " ".join(f"v{k % (7 + i)}" for k in range(400)), None, None) for i in range(30)],
]
SMALL = [(i, t if t is None or len(t) < 20_000 else t[:9_000], g, s) for i, t, g, s in cases.TEXTS]


@pytest.mark.parametrize("whole", [128, runs.WHOLE])
def test_documents_equal_brute_force(spark, whole):
    docs = cases.documents(spark, SMALL + PERIODIC)
    found = runs.periodic_runs(docs, rewrite=queries.planted_period, whole=whole)
    assert cases.rows(found) == sorted((brute_row(i, t, True) for i, t, _, _ in SMALL + PERIODIC), key=repr)


def test_the_table_equals_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    expected = sorted((brute_row(d["doc_id"], d["text"], True) for d in docs if len(d["text"] or "") < 9_000), key=repr)
    short = {r[0] for r in expected}
    found = queries.op12_octave_tile_runs(spark, "/root/testdata/sf0.001")
    assert [r for r in cases.rows(found) if r[0] in short] == expected


def test_without_rewriting_and_empty_table(spark):
    docs = cases.documents(spark, SMALL)
    assert cases.rows(runs.periodic_runs(docs)) == sorted((brute_row(i, t, False) for i, t, _, _ in SMALL), key=repr)
    assert runs.periodic_runs(cases.empty(spark)).count() == 0
