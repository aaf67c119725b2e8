"""Models from Gram matrices against plain NumPy."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltgrid.operators import linear, models

RNG = np.random.default_rng(3)
N = 240
X = RNG.normal(size=(N, 3)) * [1, 5, 0.1] + [3, -2, 0]
X[:60, 1] = 0.0  # a value that is very common
Y = X @ [0.5, 0.2, -3.0] + RNG.normal(size=N) * 0.3


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, X[i]), 7.0, float(Y[i])) for i in range(N)], "id long, a double, b double, c double, flat double, target_original double").cache()


FEATURES = ["a", "b", "c", "flat"]


def folds_of(rows):
    return np.array([r.f for r in rows.select(models.fold_of("id", 5).alias("f"), "id").orderBy("id").collect()])


def scaled(train, scaler):
    spread = train.std(axis=0, ddof=1) if scaler == "standard" else np.subtract(*np.percentile(train, [75, 25], axis=0))
    return (train - train.mean(axis=0)) / spread, spread


@pytest.mark.parametrize("scaler", ["standard", "robust"])
@pytest.mark.parametrize("algorithm", ["ridge", "elastic_net", "lasso"])
def test_weights_are_optimal(rows, scaler, algorithm):
    prepared = linear.prepared(rows, FEATURES, ["target_original"], "id", 5, 42, False)
    fitted = {r.held: r for r in linear.models(prepared, FEATURES, [("target_original", scaler, algorithm)], 5).collect()}
    penalty, share = linear.PENALTIES[algorithm]
    fold = folds_of(rows)
    assert len(fitted) == 5
    for held, r in fitted.items():
        z, spread = scaled(X[fold != held], scaler)
        y = Y[fold != held]
        w = np.array(r.weights[:3]) * spread
        assert r.weights[3] == 0.0 and abs(r.intercept - (y.mean() - X[fold != held].mean(axis=0) @ r.weights[:3])) < 1e-9
        slope = z.T @ (y - y.mean() - z @ w) / len(y) - penalty * (1 - share) * w  # zero where w is not, else inside the penalty
        assert np.abs(np.where(w != 0, slope - penalty * share * np.sign(w), 0)).max() < 1e-8
        assert (np.abs(slope[w == 0]) <= penalty * share + 1e-9).all()


def test_metrics_of_held_out_rows(rows):
    got = {r.fold: r for r in linear.cross_validated(rows, FEATURES, [("target_original", "standard", "ridge")], "id").collect()}
    fold = folds_of(rows)
    for held, r in got.items():
        z, spread = scaled(X[fold != held], "standard")
        y = Y[fold != held]
        w = np.linalg.solve(z.T @ z / len(y) + 0.5 * np.eye(3), z.T @ (y - y.mean()) / len(y)) / spread
        p = y.mean() + (X[fold == held] - X[fold != held].mean(axis=0)) @ w
        t = Y[fold == held]
        assert abs(r.rmse - np.sqrt(np.mean((p - t) ** 2))) < 1e-9 and abs(r.r2 - (1 - np.mean((p - t) ** 2) / t.var())) < 1e-9
        assert r.n_samples == (fold == held).sum()


def test_search_finds_a_small_penalty(rows):
    best = linear.search(rows, FEATURES, "target_original", "id", "elastic_net", trials=12).first()
    first = linear.summary(linear.cross_validated(rows, FEATURES, [("target_original", "standard", "elastic_net")], "id")).first()
    assert best.r2 >= first.r2 and 1e-3 <= best.penalty <= 10


def test_quantile_members_and_missing_ones(spark, rows):
    missing = spark.createDataFrame([("original", "quantile", "ridge"), ("original", "standard", "lasso"), ("original", "standard", "random_forest")], "transform string, scaler string, algorithm string")
    got = {(r.scaler, r.algorithm) for r in linear.train_missing(rows, FEATURES, missing, "id").collect()}
    assert got == {("quantile", "ridge"), ("standard", "lasso")}
    assert linear.cross_validated(rows.limit(0), FEATURES, [("target_original", "standard", "ridge")], "id").count() == 0


def test_normal_quantiles(spark):
    ps = [1e-300, 1e-12, 1e-7, 0.001, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9999, 1 - 1e-12]
    out = spark.createDataFrame([(p,) for p in [*ps, None, 0.0, 1.0]], "p double").select("p", models.inverse_normal(F.col("p")).alias("z")).collect()
    for r in out[:len(ps)]:
        want = NormalDist().inv_cdf(r.p)
        assert abs(r.z - want) <= 1e-13 * max(1, abs(want)) * 10
    assert [r.z for r in out[len(ps):]] == [None, float("-inf"), float("inf")]


def test_quantile_scale_keeps_nulls(spark):
    out = {r.id: r.v for r in models.quantile_scale(spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None), (3, 9.0)], "id long, v double"), ["v"]).collect()}
    assert out[2] is None and out[1] == 0.0 and abs(out[0] + out[3]) < 1e-12
