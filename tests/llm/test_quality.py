import cases
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from offerscope.llm import quality
from offerscope.llm.queries import queries

SF = "/root/testdata/sf0.01"


def brute(net, text):
    """The network's definition, window by window."""
    data = text + bytes(max(0, quality.WIDTH - len(text)))
    windows = len(data) - quality.WIDTH + 1
    outputs = np.array(
        [sum(net.filters[k][data[i + k]] for k in range(quality.WIDTH)) for i in range(windows)], np.float64
    )
    half = quality.CHUNK // 2
    starts = range(0, max(1, windows - half), half) if windows > half else [0]
    pooled = np.mean([np.maximum(outputs[a : a + quality.CHUNK].max(0) + net.bias, 0) for a in starts], axis=0)
    z = np.append(pooled, quality.fill(len(text))) @ net.weights + net.offset
    return 1 / (1 + np.exp(-z))


def network():
    rng = np.random.default_rng(1)
    f = quality.FILTERS
    return quality.Network(
        rng.normal(0, 0.3, (quality.WIDTH, 256, f)).astype(np.float32),
        rng.normal(0, 0.1, f).astype(np.float32),
        rng.normal(0, 0.3, f + len(quality.SHORT)),
        0.1,
    )


def test_scores_equal_the_definition(monkeypatch):
    net = network()
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"abcdef", *[bytes(rng.integers(0, 256, n).tolist()) for n in (7, 255, 256, 261, 262, 511, 517, 518, 1500, 5000)]]
    expected = [brute(net, t) for t in texts]
    assert np.allclose(quality.scores(net, texts), expected, atol=1e-5)
    monkeypatch.setattr(quality, "BLOCK", 1024)  # long texts by blocks
    assert np.allclose(quality.scores(net, texts), expected, atol=1e-5)


def test_defined_results(spark):
    rows = quality.score(cases.documents(spark), network()).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(cases.empty(spark), network()).count() == 0
    assert quality.scores(quality.train([], []), [b"x"]).tolist() == [0.5]
    assert quality.scores(quality.train([b"a", b"b"], [1, 1]), [b"x"])[0] > 0.99


def test_sample_is_bounded_and_leaves_out_what_may_not_be_learnt(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(docs)
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    texts, marks = quality.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda k: F.col(k) >= 150, rows=30)
    assert len(texts) == len(marks) == 30
    assert all(int(t.split()[1]) >= 150 and int(t.split()[1]) % 2 == y for t, y in zip(texts, marks))


def test_held_out_accuracy(spark):
    found = queries()["op6_quality_network"](spark, SF).toPandas()
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert len(found) == len(docs)
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    good = held[held.quality == 1]
    assert (held.predicted == held.quality).mean() > 0.9 and good.predicted.mean() > 0.97


def test_repeated_and_foreign_keys_leave_the_sample_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(7, "text 7")] * 60, "doc_id long, text string")
    rows = [(i, i % 2) for i in range(20)] + [(7, 1)] * 60 + [(i, 1) for i in range(1000, 1400)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    texts, marks = quality.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda key: F.lit(True), rows=20)
    assert sorted(zip(texts, marks)) == sorted((f"text {i}".encode(), i % 2) for i in range(20))


def test_kept_texts_are_sent_once_and_copied_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIED", 3)
    docs = cases.documents(spark)
    kept = quality.score(docs, network(), keep=docs.columns, name="s")
    assert kept.columns == [*docs.columns, "s"]
    assert "_whole_text" not in kept._jdf.queryExecution().toString()
    alone = sorted((str(r["doc_id"]), r["score"]) for r in quality.score(docs, network()).collect())
    rows = sorted((str(r["doc_id"]), r["s"]) for r in kept.collect())
    assert [k for k, _ in rows] == [k for k, _ in alone]
    assert np.allclose([s for _, s in rows], [s for _, s in alone], rtol=0, atol=1e-12)
    import pyarrow as pa

    column = pa.array(["a", None, "", "é", "b", "c", "d"])
    assert list(quality.whole_texts(column)) == [b"a", b"", b"", "é".encode(), b"b", b"c", b"d"]
    assert quality.BLOCK * quality.FILTERS * 4 <= 1 << 23


def test_workers_let_go_of_an_encoder_of_another_step(spark):
    import pyarrow as pa

    def keep(batches):
        import sys, types

        kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
        kept.mark, kept.encoder = None, bytes(1000)
        yield from batches

    def look(batches):
        import sys

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array(["_kept_encoders" in sys.modules], pa.bool_())})

    numbers = spark.range(0, 64, 1, 8)
    docs = spark.createDataFrame([(i, "some text") for i in range(64)], "doc_id long, text string").repartition(8)
    numbers.mapInArrow(keep, "id long").count()
    assert any(r["held"] for r in numbers.mapInArrow(look, "held boolean").collect())
    for _ in range(10):  # until every worker has had a task
        quality.score(docs, network()).count()
        quality.score(docs, network()).collect()
    held = [r["held"] for r in numbers.mapInArrow(look, "held boolean").collect()]
    assert not any(held)
