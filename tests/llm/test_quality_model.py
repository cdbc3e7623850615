"""Quality classifier: held-out accuracy, and the training and scores against plain versions."""

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import quality_model, queries
from gridloom.llm.quality_model import SLOTS, Settings

SF_DIR = "/root/testdata/sf0.01"


def held(doc_id):
    return crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op11_quality_model(spark, SF_DIR).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == held(k) and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    out = [(rows[k].score, q) for k, q in labels.items() if held(k)]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    above = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(bad) >= 5 and above >= 0.97
    assert np.mean([s >= 0.3 for s in good]) >= 0.97 and np.mean([s < 0.3 for s in bad]) >= 0.8


def test_training_against_plain_updates():
    draw = np.random.default_rng(5)
    rows = []
    for i in range(60):
        slots = np.sort(draw.choice(40, 6, replace=False)).astype(np.int32)
        rows.append((int(slots[0] < 5), slots, draw.random(6).astype(np.float32)))
    settings = Settings(epochs=2, l1=0.05, l2=0.1, alpha=0.3)
    model = quality_model.fit(rows, settings)
    z, n, ones = Counter(), Counter(), sum(r[0] for r in rows)
    share = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        rate = (settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2
        return -(z[i] - (1 if z[i] > 0 else -1) * settings.l1) / rate

    for _ in range(2):
        for label, slots, x in rows:
            terms = [*zip(slots.tolist(), x.astype(float).tolist()), (SLOTS, 1.0)]
            w = {i: weight(i) for i, _ in terms}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in terms)))
            for i, v in terms:
                g = v * (p - label) * share[label]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / settings.alpha * w[i]
                n[i] += g * g
    want = [weight(i) for i in range(40)]
    assert np.allclose(model.weights[:40], want, atol=1e-6) and abs(model.bias - weight(SLOTS)) < 1e-9
    assert np.count_nonzero(model.weights) <= 40


def test_scores_are_sparse_dot_products():
    texts = ["the cat sat", None, "", "THE!! CAT!! THE!! CAT!!", "a a a a", "x | y | z", " ".join(map(str, range(3000)))]
    draw = np.random.default_rng(1)
    weights = np.append(draw.normal(size=SLOTS), 0).astype(np.float32)
    settings = Settings()
    scores = quality_model.score_texts(pa.array(texts), quality_model.Model(weights, 0.25), settings)
    for (slots, x), score in zip(quality_model.text_features(pa.array(texts), settings), scores):
        assert score == pytest.approx(1 / (1 + np.exp(-(float(x @ weights[slots]) + 0.25))), abs=1e-9)
    assert scores[1] == scores[2] == pytest.approx(1 / (1 + np.exp(-0.25)))


def test_a_text_scores_alike_in_any_batch():
    texts = ["one two", "two two", "Three & 3", "one two"]
    alone = [quality_model.text_features(pa.array([t]), Settings())[0] for t in texts]
    for (a, x), (b, y) in zip(alone, quality_model.text_features(pa.array(texts), Settings())):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_labels_with_gaps(spark):
    """Conflicting, missing and unknown labels teach nothing; without one of the labels all scores are 0.5."""
    documents = spark.createDataFrame(
        [(1, "good text"), (1, "other text"), (2, "BAD!!"), (3, None), (None, "x"), (5, "y")], "doc_id long, text string"
    )
    labels = [(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (5, None), (6, 7)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    settings = Settings()
    sample = quality_model.train_sample(documents, frame, "doc_id", "text", "quality", settings)
    assert sorted((r.id, r.label, r.text) for r in sample.collect()) == [(1, 1, "good text"), (3, 0, None)]
    model = quality_model.fit(quality_model.collect_features(sample.filter("label = 1"), settings), settings)
    scored = quality_model.predict(documents.withColumn("score", documents.text), "doc_id", "text", model)
    assert [r.score for r in scored.collect()] == [0.5] * 6
