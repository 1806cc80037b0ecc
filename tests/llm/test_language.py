import cases
import pandas as pd
from conftest import SF_DIR

from offerscope.llm import language
from offerscope.llm.queries import queries


def brute_counts(text):
    """n-grams of one to three characters, gaps between words as one space, by plain Python."""
    points = [c if len(c) == 1 and c.isalpha() else " " for c in text.lower()]
    line = " "
    for c in [*points, " "]:
        if c != " " or line[-1] != " ":
            line += c
    found = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g.strip():
                found[g] = found.get(g, 0) + 1
    return found


def code(gram):
    return sum((1 if c == " " else ord(c)) << 21 * i for i, c in enumerate(gram))


def test_counts_equal_brute_force_for_any_block(monkeypatch):
    for size in (1 << 20, 7, 3):
        monkeypatch.setattr(language, "BLOCK", size)
        for _, text, _, _ in cases.TEXTS:
            text = (text or "")[:3000]
            codes, n = language.NGrams().count(text)
            assert dict(zip(codes.tolist(), n.tolist())) == {code(g): k for g, k in brute_counts(text).items()}


def test_defined_results(spark):
    docs = cases.documents(spark)
    profiles = language.learn(docs)
    assert set(profiles) == {"en", "de", "fr"}
    rows = language.identify(docs, profiles).collect()
    assert len(rows) == len(cases.TEXTS)
    by_text = {(i, t): None for i, t, _, _ in cases.TEXTS}
    assert {r["doc_id"] for r in rows} == {i for i, _ in by_text}
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (3, 4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 10)} == {"en"}


def test_distance_equals_brute_force():
    profiles = {"a": [5, 9, 2], "b": [9, 5, 7]}
    own = [9, 2, 4]
    import numpy as np

    name, score = language.Profiles(profiles, 3).nearest(np.array(own))
    distance = {k: sum(abs(i - p.index(g)) if g in p else 3 for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    assert (name, round(score, 12)) == (best, round(1 - distance[best] / 9, 12))


def test_empty_tables(spark):
    assert language.learn(cases.empty(spark)) == {}
    assert {r["lang_pred"] for r in language.identify(cases.documents(spark), {}).collect()} == {"und"}
    assert language.identify(cases.empty(spark), {"en": [1]}).count() == 0


def test_held_out_accuracy(spark):
    found = queries()["op1_rank_order_language"](spark, SF_DIR).toPandas()
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    both = found.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(found) == len(docs) and (held.lang_pred == held.lang).mean() > 0.95
