"""The three classifiers: held-out accuracy on the driver's tables, and edge cases."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlark.llm import language, quality, queries, texts, toxicity

SF_DIR = "/root/testdata/sf0.01"
EDGES = [None, "", " \n", "12 34", "a", "word " * 60_000, "!!! ???", "Ωμέγα", "same text", "same text"]
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")


def labelled(spark, name):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col(name).alias("label"))


def auc(rows):
    rank = np.argsort(np.argsort([r["score"] for r in rows])) + 1.0
    label = np.array([r["label"] for r in rows])
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@needs_data
def test_quality_on_held_out_labels(spark):
    found = queries.op10_quality(spark, SF_DIR)
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = found.filter("held_out").join(labelled(spark, "quality"), "doc_id").collect()
    assert auc(rows) > 0.97
    assert not [r for r in rows if r.label == 1 and r.predicted == 0]


@needs_data
def test_toxicity_on_held_out_labels(spark):
    rows = queries.op4_toxicity(spark, SF_DIR).filter("held_out").join(labelled(spark, "toxic"), "doc_id").collect()
    # 320 rows to learn from here, 32 of them toxic.
    assert auc(rows) > 0.85
    assert sum(r.toxic for r in rows if r.label == 0) <= 0.05 * len(rows)


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2_language(spark, SF_DIR).filter("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def edges(spark):
    return spark.createDataFrame([(i, t, "kept", 7.0) for i, t in enumerate(EDGES)], "doc_id long, text string, lang_pred string, score double")


def test_quality_edges(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(5, 0), (6, 0), (8, 1), (9, 1), (0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(labels, docs)
    rows = {r.doc_id: r for r in quality.score_texts(docs, model).collect()}
    assert len(rows) == len(EDGES) and rows[0].score == rows[1].score == rows[2].score and rows[8].score == rows[9].score
    assert all(0 <= r.score <= 1 and r.lang_pred == "kept" for r in rows.values())
    none = quality.fit(labels.limit(0), docs)
    assert {r.score for r in quality.score_texts(docs, none).collect()} == {0.5}
    assert quality.score_texts(docs.limit(0), model).count() == 0


def test_quality_training_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.training_rows(labels, docs, "quality", 30).count() == 30
    one, two = (quality.fit(labels, docs, rows=30) for _ in range(2))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_ftrl_matches_a_dense_step():
    params = quality.Ftrl(buckets=8, alpha=0.5, beta=1.0, l1=0.0, l2=0.0, epochs=1)
    model = quality.train_stream(iter([(np.array([3]), np.array([2.0]), 1.0)]), params)
    # One step from zero: p = 1/2, g = -1, n = 1, z = g, w = -z * alpha / (beta + 1).
    assert model.weights[3] == pytest.approx(0.25) and model.bias == pytest.approx(0.5 * 0.5 / 1.5)


def test_language_edges(spark):
    docs = edges(spark).withColumn("lang", F.when(F.col("doc_id") > 3, "xx"))
    net = language.fit(docs)
    rows = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["und"] * 4 and rows[0].score == 0
    assert rows[4].lang_pred == "xx" and rows[4].score == 1 and rows[6].lang_pred == "und"
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), net).count() == 0


def test_every_language_trains_and_copies_count_once(spark):
    """300 languages of two texts each, one of them beside a text that is copied 5,000 times."""
    words = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("ko", "mi", "ta", "re", "su") * 6)
    rows = [(f"l{i:03d}", words(i) + tail) for i in range(300) for tail in ("", " x")] + [("l007", "the one text that is everywhere")] * 5_000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    sample = language.training_windows(docs).toPandas()
    assert sample.lang.nunique() == 300
    assert sample.groupby("lang").size().max() <= 3 * language.WINDOWS_PER_DOC
    assert set(sample[sample.lang == "l007"].window.map(lambda w: bytes(w)[:3])) >= {b"the"}


def test_language_scores_do_not_depend_on_batching(monkeypatch):
    rng = np.random.default_rng(1)
    net = language.Network(("a", "b"), tuple(rng.normal(size=(w, 256, 4)).astype("f4") for w in (2, 3)), np.zeros(8, "f4"), rng.normal(size=(8, 2)), np.zeros(2))
    data, at = texts.text_buffers(pa.array(["x" * n + "yz" * (n % 7) for n in (0, 1, 500, 127, 128, 129, 5_000, 3)]))
    results = []
    for batch in (1, 3, 1_000):
        monkeypatch.setattr(language, "BATCH", batch)
        results.append(np.concatenate([t for _, _, t in language.text_scores(data, at, net)]))
    assert np.allclose(results[0], results[1], atol=1e-4) and np.allclose(results[0], results[2], atol=1e-4)


def test_toxicity_edges(spark):
    rows = [(i, f"plain words {i} here", 0) for i in range(60)] + [(100 + i, f"plain scum {i} here", 1) for i in range(60)] + [(300, None, 1), (301, "", 0)]
    sample = toxicity.with_categories(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    chain = toxicity.fit(sample)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate([*EDGES, "total scum", "all plain"])], "doc_id long, text string, p_toxic double")
    found = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    assert found[10] > 0.5 > found[11] and found[0] == found[1] and found[8] == found[9]
    empty = toxicity.fit(sample.limit(0))
    assert {r.p_toxic for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_later_links_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    n = 600
    first = rng.random(n) < 0.5
    row = np.arange(n)
    chain = toxicity.train(row, np.where(first, 11, 22).astype(np.uint64), np.column_stack([first, first]).astype(float), ("a", "b"))
    assert chain.earlier[1, 0] > 0 and chain.earlier[0].tolist() == [0, 0]


def test_long_texts_hash_like_short_pieces():
    words = ["alpha", "Beta!!", "gamma", "x" * 3_000] * 300
    whole = " ".join(words)
    assert len(whole) > 2 * texts.SLICE_BYTES
    h, first = texts.token_hashes(*texts.text_buffers(pa.array([whole])))
    assert len(set(h.tolist())) == 5 and first.tolist() == [0, 5 * 300]
