"""Each stage on its own input against a brute-force version, with the given models."""

import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from conftest import SF_DIR
from test_secrets import base_spans
from test_shingle_join import brute
from tokenizers import Tokenizer

from offerscope.llm import language
from offerscope.llm.queries import word_vocabulary
from offerscope.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs.toPandas()]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF_DIR), name)
        found.append(docs.toPandas())
    return found


def ids(rows):
    return sorted(rows.doc_id.tolist())


def test_columns(steps):
    for step in steps[:-1]:
        assert list(step.columns) == COLUMNS


def test_quality_keeps_what_the_network_accepts(steps, spark):
    before, after = steps[0], steps[1]
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    marked = before.merge(labels, on="doc_id")
    good = marked[marked.quality == 1]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) < len(before)
    assert good.doc_id.isin(after.doc_id).mean() > 0.97
    same = before.set_index("doc_id").loc[after.doc_id]
    assert (same.text.values == after.text.values).all()


def test_language_equals_brute_force(steps, spark):
    before, after = steps[1], steps[2]
    learnt = spark.createDataFrame(before[[zlib.crc32(str(i).encode()) % 3 != 1 for i in before.doc_id]])
    known = language.Profiles(language.learn(learnt), language.PROFILE_SIZE)
    grams = language.NGrams()
    judged = [known.nearest(language.top(grams.count(t), language.PROFILE_SIZE)) for t in before.text]
    kept = [n != "und" and s >= corpus_pipeline.LEAST_LIKENESS for n, s in judged]
    assert ids(after) == ids(before[kept])


def test_one_of_each_group_equals_brute_force(steps):
    before, after = steps[2], steps[3]
    components = brute(list(zip(before.doc_id.tolist(), before.text.tolist())))
    assert ids(after) == sorted({c for _, _, c in components})


def test_secrets_are_gone_and_the_rest_is_as_it_was(steps):
    before, after = steps[3].set_index("doc_id"), steps[4].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    for i in before.index:
        old, new = before.text[i], after.text[i]
        spans = base_spans(old)
        if not spans and corpus_pipeline.MARK not in new:
            assert old == new
        else:
            assert corpus_pipeline.MARK in new and not [s for s in base_spans(new)]
            for part in new.split(corpus_pipeline.MARK):
                assert part in old
        assert after.n_chars[i] == len(new)


def test_packing_holds_every_token(steps):
    before, after = steps[4], steps[5]
    library = Tokenizer.from_file(word_vocabulary())
    tokens = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in zip(before.doc_id, before.text)}
    pieces = {(r.doc_id, r.piece): r for r in after.itertuples()}
    assert len(pieces) == len(after) == sum(-(-len(x) // 2048) for x in tokens.values())
    for (doc, piece), r in pieces.items():
        part = tokens[doc][2048 * piece : 2048 * (piece + 1)]
        assert (r.start, r.length) == (2048 * piece, len(part))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    sizes = after.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and len(sizes) <= -(-after.length.sum() // 2048) + 1


def test_run_gives_the_rows_of_the_stages(steps, spark):
    found = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert len(found) == len(steps[-1]) and set(found.doc_id) == set(steps[-1].doc_id)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "language", "duplicates", "secrets", "packing",
    ]


def test_without_a_language_to_learn_from_texts_with_letters_stay(spark):
    rows = [(1, "a clean text", None), (2, "", None), (3, None, None), (4, "12 34 !", None), (5, "noch ein Text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[4]]


CLASHING = ("_whole_text", "_quality", "_language", "_likeness", "_hash", "_spans", "_key", "_text", "score", "node", "piece", "row")


def odd_documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, g, s, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, g, s in rows]
    return spark.createDataFrame(full, schema)


def test_stages_take_odd_rows_clashing_names_and_empty_tables(spark):
    sentence = "the quick brown fox jumps over the lazy dog and runs away from the old house on the hill"
    rows = [
        (1, sentence, "en", "a"), (2, sentence, "en", "b"), (2, sentence, "en", "b"), (None, sentence, "en", None),
        (3, None, "en", "a"), (4, "", None, None), (5, "token = abcdefghij0123456789 " + sentence, "en", "a"),
        (6, "der schnelle braune fuchs springt über den faulen hund und läuft weg vom alten haus", "de", "a"),
    ]
    docs = odd_documents(spark, rows)
    for name, function in corpus_pipeline.STAGES[:-1]:
        found = stage(function(spark, docs, SF_DIR), name)
        assert found.columns == docs.columns, name
        nothing = function(spark, docs.limit(0), SF_DIR)
        assert nothing.columns == docs.columns and nothing.isEmpty(), name
    assert corpus_pipeline.packed(spark, docs.limit(0), SF_DIR).isEmpty()
    assert corpus_pipeline.packed(spark, docs, SF_DIR).count() == len(rows)
    # ties: of equal texts the smallest id stays, a null id counts as the last; 5 has 14 of 17 shingles in common
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 6]
    clean = {r["doc_id"]: r for r in corpus_pipeline.without_secrets(spark, docs, SF_DIR).collect()}
    assert corpus_pipeline.MARK in clean[5]["text"] and clean[5]["n_chars"] == len(clean[5]["text"])
    assert clean[1]["text"] == sentence and clean[3]["text"] is None


def test_rows_whose_short_hash_agrees_are_kept_apart(spark, monkeypatch):
    """Equal first halves of the row hash: the other half still tells rows apart."""
    from pyspark.sql import functions as F

    from offerscope.llm import shingle_join

    whole = shingle_join.row_hash
    monkeypatch.setattr(
        shingle_join, "row_hash", lambda key, text: F.struct(F.lit(0).cast("long").alias("a"), whole(key, text)["b"].alias("b"))
    )
    rows = [(i, f"some words of text number {i} and secret = abcdef0123456789{i} or more of them", "en", "a", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).count() == 6
    clean = corpus_pipeline.without_secrets(spark, docs, SF_DIR).collect()
    assert len(clean) == 6 and all(f"number {r['doc_id']} " in r["text"] and "abcdef" not in r["text"] for r in clean)
