import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import toxicity as tox


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(300)]
    bad = ["awful", "vile", "nasty"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(plain, 30))
        if toxic:
            words[int(rng.integers(30))] = str(rng.choice(bad))
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", toxic))
    return rows


def test_learns_and_holds_out(spark):
    rows = texts(900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in tox.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    right = [out[i].predicted == y for i, _, _, y in rows if out[i].held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    flipped = spark.createDataFrame([(r[0], 1 - r[3] if out[r[0]].held_out else r[3]) for r in rows], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in tox.score_documents(docs.withColumnRenamed("lang", "x").selectExpr("*", "x AS lang"), flipped).collect()}
    assert all(again[i] == pytest.approx(out[i].score) for i in again)  # held-out labels are never read
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 500 < kept.count() < 720


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double, predicted string"
    docs = spark.createDataFrame([(1, None, None, 0.0, ""), (2, "", "en", 0.0, ""), (2, "", "en", 0.0, ""), (None, "a b", "fr", 0.0, ""), (4, "nasty " * 60_000, "xx", 0.0, "")], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tox.score_documents(docs, none).collect()] == [0.0] * 5
    one = spark.createDataFrame([(2, 1), (4, None), (None, 1), (1, 7)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in tox.score_documents(docs, one).collect())
    assert tox.score_documents(docs.limit(0), none).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in tox.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hits = np.mean([r.predicted for r in rows if labels[r.doc_id] == 1])
    false = np.mean([r.predicted for r in rows if labels[r.doc_id] == 0])
    assert hits > 0.8 and false < 0.01


def test_thresholds_are_of_all_labelled_rows(spark):
    # A language of 3 % of the labels, with a word of the others' toxic rows in its clean ones.
    rows = [(i, t.replace("w1 ", "vile ") if i % 33 == 0 else t, "xx" if i % 33 == 0 else lang, y) for i, t, lang, y in texts(10_000, 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels, tox.Settings(max_positive=300, max_negative=600, epochs=2, min_positive=20))
    assert set(model.thresholds) == {"en", "fr", "xx"}
    own = {r.doc_id: r.s for r in docs.select("doc_id", tox.scorer(spark, model)("text").alias("s")).collect()}
    for lang in (None, *model.thresholds):  # the false share is bounded on all of them, not on some of a sample
        clean = [own[i] >= model.thresholds.get(lang, 0.5) for i, _, x, y in rows if y == 0 and zlib.crc32(str(i).encode()) % 5 and lang in (None, x)]
        assert sum(clean) <= 0.02 * len(clean)


def test_cut():
    bins, positive, negative = np.array([5, 9, -3, 7]), np.array([3, 5, 0, 1]), np.array([1, 0, 999, 0])
    assert tox._cut(bins, positive, negative, 0.01) == (5 - 2) / 2 / tox.BINS
    assert tox._cut(bins, positive, negative, 0.0) == 6 / tox.BINS


def test_labels_of_any_number_type(spark):
    rows = texts(300)
    docs = spark.createDataFrame([(str(r[0]), *r[1:3]) for r in rows], "doc_id string, text string, lang string")
    scores = []
    for kind in ("bigint", "double", "tinyint"):
        labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int").withColumn("toxic", F.col("toxic").cast(kind))
        scores.append({r.doc_id: r.score for r in tox.score_documents(docs, labels, tox.Settings(epochs=1)).collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 300
