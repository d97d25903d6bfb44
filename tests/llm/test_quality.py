import math

import helpers as H
import numpy as np
import pytest

from strandloom.llm import quality as Q


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on half of the labelled rows, the classifier finds bad documents of the other half and leaves clean ones."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in Q.classify(docs, labels.where("doc_id % 2 = 0"), ["doc_id"]).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    clean = [got[r.doc_id].keep for r in test if r.quality == 1 and r.toxic == 0]
    low = [got[r.doc_id].keep for r in test if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(low) < 0.3


def test_sites_shrink_to_parents(spark):
    rows = [("big", "en", 3.0, -9.0)] * 300 + [("big2", "en", -3.0, -9.0)] * 300 + [("tiny", "en", 3.0, -9.0)] + [(None, None, -3.0, -9.0)] * 5
    got = {(r.source, r.lang): r.shift_bad for r in Q.site_rates(spark.createDataFrame(rows, "source string, lang string, _bad double, _toxic double")).collect()}
    assert got["big", "en"] > got["tiny", "en"] and got["big2", "en"] < 0
    assert (None, None) in got and all(math.isfinite(x) for x in got.values())


def test_without_labels_and_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = Q.classify(H.odd_rows(spark), labels, ["doc_id", "text"]).collect()
    assert len(got) == 9 and all(r.keep and abs(r.p_low - 0.5) < 1e-9 for r in got)
    assert Q.classify(H.docs(spark, ["a"]).limit(0), labels, ["doc_id"]).collect() == []
    assert Q.classify(H.docs(spark, ["a"], extra=True), labels, ["doc_id", "n"]).first().n == "x"


def test_fit_separates():
    rows = [(f"good plain words number {i}".encode(), 0) for i in range(60)] + [(f"GRAB!! NOW!! {i}!!".encode(), 1) for i in range(40)]
    w = Q.fit(rows)
    data = b"".join(r[0] for r in rows)
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    assert ((Q.log_odds(np.frombuffer(data, np.uint8), at, [w])[:, 0] > 0) == [r[1] for r in rows]).all()
    assert not Q.fit([(b"a", 1)]).any()


@pytest.mark.parametrize("text", [b"", b" ", b"one", "é😀".encode() * 1000])
def test_features_of_odd_texts(text):
    doc, word, shape = Q.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.isfinite(shape).all() and shape.shape == (1, Q.SHAPES)
