import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, SF, awkward, empty, given, row
from voltgrid.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def plain_model(x, y, pooling, ridge, weight):
    """The same discriminant through covariances, solve and slogdet."""
    n, means = [(y == k).sum() for k in (0, 1)], [x[y == k].mean(axis=0) for k in (0, 1)]
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])

    def score(z):
        d = []
        for m, c in zip(means, covs):
            s = (1 - ridge) * ((1 - pooling) * c + pooling * pooled) + ridge * np.diag(np.diag(pooled) + 1e-6)
            d.append(-0.5 * (z - m) @ np.linalg.solve(s, z - m) - 0.5 * np.linalg.slogdet(s)[1])
        return 1 / (1 + math.exp(-max(-700, min(700, weight * (d[1] - d[0]) + math.log(n[1] / n[0])))))
    return score


def labelled(spark):
    rng = np.random.default_rng(1)
    words = ["house", "river", "old", "man", "the", "a", "walks", "by"]
    rows, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        text = " ".join(rng.choice(words, rng.integers(5, 60))) + "." if good else ("BUY!! " if i % 2 else "spam spam | ") * int(rng.integers(5, 40))
        rows.append(row(i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_moments_choice_and_scores_equal_a_plain_version(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    stats = quality.features(docs)
    model = quality.train(stats, spark.createDataFrame(labels, LABELS), F.lit(True))
    x, y = np.array([quality.statistics(r[1]) for r in rows]), np.array([q for _, q, _ in labels])
    folds = np.array([r.f for r in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("f"), "doc_id").orderBy("doc_id").collect()])
    losses = {}
    for p, r, w in quality.product(quality.POOLING, quality.RIDGE, quality.WEIGHT):
        total = 0.0
        for f in range(5):
            score = plain_model(x[folds != f], y[folds != f], p, r, w)
            for z, k in zip(x[folds == f], y[folds == f]):
                s = min(1 - 1e-9, max(1e-9, score(z)))
                total -= math.log(s if k else 1 - s)
        losses[p, r, w] = round(total, 6)
    p, r, w = min(losses, key=losses.get)
    score = plain_model(x, y, p, r, w)
    got = {d.doc_id: d.score for d in quality.scored(stats, model).collect()}
    assert model.weight == w and all(abs(got[i] - score(z)) < 1e-6 for i, z in enumerate(x))


def test_awkward_rows_have_scores(spark):
    rows, labels = labelled(spark)
    df = spark.createDataFrame(rows, SCHEMA).unionByName(awkward(spark))
    twice = [*labels, (0, None, 0), (0, 1, 0), (None, 1, 0), (999, 1, 0), (5, 7, 0)]
    out = quality.quality(df, spark.createDataFrame(twice, LABELS), F.lit(True)).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.statistics(None) == quality.statistics("") and len(quality.statistics("\n \n")) == quality.SIZE


def test_few_labels_and_empty_tables(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.quality(docs, none, F.lit(True)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], LABELS)
    assert {r.score for r in quality.quality(docs, ones, F.lit(True)).collect()} == {1.0}
    assert quality.quality(empty(spark), ones).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = labelled(spark)
    stats = quality.features(spark.createDataFrame(rows, SCHEMA))
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality.scored(stats, quality.train(stats, spark.createDataFrame(x, LABELS), quality.learned_from())).collect() for x in (labels, turned))
    assert {r.doc_id: round(r.score, 9) for r in a} == {r.doc_id: round(r.score, 9) for r in b}


@pytest.mark.skipif(not given(), reason="given tables absent")
def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r.doc_id: r.predicted for r in quality.quality(docs, labels).collect()}
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, junk = [p for p, q in held if q == 1], [p for p, q in held if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(p == 0 for p in junk) >= 0.8 * len(junk)
