import random

import numpy as np
from pyspark.sql import functions as F

from tribune.llm import quality


def corpus(rng, n):
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["the", "and", "that", "of", "with"]) if rng.random() < 0.4 else "".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(60)]
        good = rng.random() < 0.75
        if not good:
            words = [w + "###" if rng.random() < 0.7 else w for w in words]
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(1), 700)
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (901, "", "x"), (902, "the and " * 50_000, "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, quality int")
    held = F.col("doc_id") % 5 == 0
    weights = quality.train(docs, known, learnable=~held)
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    truth = dict(labels)
    out = [(got[k] >= quality.THRESHOLD) == bool(truth[k]) for k in truth if k % 5 == 0]
    assert np.mean(out) > 0.97
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    again = quality.train(docs.repartition(5), known.repartition(3), learnable=~held)
    assert np.allclose(weights, again)


def test_sample_is_bounded_and_labels_may_lack(spark):
    rows, labels = corpus(random.Random(2), 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert np.any(quality.train(docs, known, sample_rows=60))
    none = quality.train(docs, known.limit(0))
    assert not none.any()
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def test_score_is_the_dot_product():
    known = quality._Words()
    rng = np.random.default_rng(3)
    w = rng.normal(size=1 << quality.BITS)
    texts = ["One two, TWO two!", "", "a", "x y z"]
    feats, sizes = quality.features(texts, known)
    got = quality._mean_weights(w, feats, sizes)
    for k, text in enumerate(texts):
        own, n = quality.features([text], known)
        assert got[k] == (0 if not n[0] else np.mean([w[own[:, j]].sum() for j in range(n[0])]).item()) or np.isclose(got[k], w[own].sum() / n[0])


def test_ftrl_learns():
    rng = np.random.default_rng(4)
    truth = rng.normal(size=30)
    examples = []
    for _ in range(3000):
        idx = np.sort(rng.choice(30, 5, replace=False))
        x = rng.normal(size=5)
        examples.append((idx, x, float(truth[idx] @ x > 0)))
    w = quality.ftrl(iter(examples), 30)
    assert np.mean([(w[i] @ x > 0) == (y > 0.5) for i, x, y in examples]) > 0.93
