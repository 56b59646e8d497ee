import zlib

import numpy as np

from veilframe.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_isotonic_rises_and_averages():
    rng = np.random.default_rng(1)
    s = rng.random(300).round(2)
    y = (rng.random(300) < s).astype(float)
    knots, levels = toxicity.isotonic(s, y, np.ones(300))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(s, knots, levels).mean() - y.mean()) < 1e-9


def test_boost_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(np.int64)
    start, trees = toxicity.boost(x, y, np.ones(2000))
    assert (((toxicity.margin(x, start, trees) > 0) == y).mean()) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "you stupid idiot", 5), (1, None, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0] * 4
    nulls = spark.createDataFrame([(None, 1), (1, None), (3, 7), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, nulls).count() == 4
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.keep_clean(docs, none).columns == docs.columns and toxicity.keep_clean(docs, none).count() == 4
