"""Linear demand models from one Gram matrix: all targets, scalers, penalties and folds from a single scan.

A Gram matrix of (1, features, targets) holds everything that a least-squares model needs, adds up over rows, and the
matrix of a training set is the whole one less that of the held-out fold. Scaling by centre and spread is arithmetic on the
matrix, so each configuration is solved on a matrix of the number of features, on the driver, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.operators import targets as targets_
from voltgrid.operators.models import fold_of, quantile_scale
from voltgrid.operators.ordered import average_ranks, correlation_with_ranks, percentiles

#: Penalty and its absolute-value share per algorithm (fixed values).
PENALTIES = {"ridge": (0.5, 0.0), "elastic_net": (0.05, 0.7), "lasso": (0.05, 1.0)}
SCALERS = ("standard", "robust", "quantile")
RANKED, PLACE = "_q_", "_place_"


def gram_matrices(rows: DataFrame, columns: Sequence[str], fold: str = "fold") -> dict[int, np.ndarray]:
    """Sums of outer products of (1, columns) per fold: added up in tasks, then by Spark; the driver gets one matrix per fold."""
    p = len(columns) + 1
    schema = pa.schema([(fold, pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), *(b.column(c).to_numpy() for c in columns)])
            folds = b.column(fold).to_numpy()
            for f in np.unique(folds).tolist():
                sums[f] = sums.get(f, 0) + z[folds == f].T @ z[folds == f]
        for f, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p * p, f, np.int32)), pa.array(np.arange(p * p, dtype=np.int32)), pa.array(g.ravel())], schema=schema)

    out: dict[int, np.ndarray] = {}
    for r in rows.select(fold, *columns).mapInArrow(run, f"{fold} int, at int, value double").groupBy(fold, "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r[fold], np.zeros(p * p))[r["at"]] = r["value"]
    return {f: g.reshape(p, p) for f, g in out.items()}


def solve(cov: np.ndarray, cross: np.ndarray, penalty: float, share: float, rounds: int = 10_000, close: float = 1e-12) -> np.ndarray:
    """Weights w that minimise half the mean squared error plus penalty * (share |w| + (1 - share) w^2 / 2).

    In closed form without the absolute part, else by coordinate descent on the covariance matrix until no weight moves.
    """
    if not share:
        return np.linalg.lstsq(cov + penalty * np.eye(len(cov)), cross, rcond=None)[0]
    w = np.zeros(len(cross))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rest = cross[j] - cov[j] @ w + cov[j, j] * w[j]
            scale = cov[j, j] + penalty * (1 - share)
            w[j] = np.sign(rest) * max(abs(rest) - penalty * share, 0.0) / scale if scale > 0 else 0.0
        if np.abs(w - before).max(initial=0) <= close * (1 + np.abs(w).max(initial=0)):
            break
    return w


def fit(gram: np.ndarray, at: Sequence[int], target: int, spread: np.ndarray | None, penalty: float, share: float) -> tuple[float, np.ndarray]:
    """Intercept and weights, for features as they are, of the model of column ``target`` on columns ``at`` of a Gram matrix.

    Features are centred and divided by ``spread``, their sample deviation if None; one without spread gets no weight.
    """
    n, mean = gram[0, 0], gram[0] / gram[0, 0]
    cov = gram / n - np.outer(mean, mean)
    s = np.sqrt(np.maximum(np.diag(cov)[at], 0) * n / max(n - 1, 1)) if spread is None else np.asarray(spread, float)
    keep = np.array([i for i in range(len(at)) if s[i] > 1e-12], int)
    weights = np.zeros(len(at))
    if len(keep):
        some, scale = np.asarray(at)[keep], s[keep]
        weights[keep] = solve(cov[np.ix_(some, some)] / np.outer(scale, scale), cov[some, target] / scale, penalty, share) / scale
    return float(mean[target] - weights @ mean[list(at)]), weights


def prepared(df: DataFrame, features: Sequence[str], target_columns: Sequence[str], row_id: str, folds: int, seed: int, ranked: bool) -> DataFrame:
    """(fold, features, ranked features, targets), written: nulls of features count as 0, rows without a target go."""
    known = df.select(row_id, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], *[F.col(t).cast("double").alias(t) for t in target_columns])
    for t in target_columns:
        known = known.filter(F.col(t).isNotNull() & ~F.isnan(t))
    known = known.withColumn("fold", fold_of(row_id, folds, seed))
    if ranked:
        known = materialize(known)
        scaled = quantile_scale(known.select(row_id, *features), features)
        known = known.join(scaled.select(row_id, *[F.col(f).alias(RANKED + f) for f in features]), row_id)
    return materialize(known)


def _spreads(rows: DataFrame, features: Sequence[str], folds: int) -> dict[tuple[str, int], float]:
    """Interquartile range of each feature over all folds but one: one row per feature and fold."""
    training = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("held <> fold")
    long = training.select("held", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("r")).select("held", "r.*")
    q = percentiles(long, ["feature", "held"], "v", {"lo": 0.25, "hi": 0.75})
    return {(r["feature"], r["held"]): r["hi"] - r["lo"] for r in q.collect()}


def models(rows: DataFrame, features: Sequence[str], configurations: Sequence[tuple[str, str, str]], folds: int) -> DataFrame:
    """(target, scaler, algorithm, held, intercept, weights) of each configuration and held-out fold, for ``prepared`` rows.

    A configuration is (target, scaler, algorithm) or (target, scaler, algorithm, penalty, share of the absolute part).
    """
    target_columns = list(dict.fromkeys(c[0] for c in configurations))
    ranked = [RANKED + f for f in features] if any(c[1] == "quantile" for c in configurations) else []
    columns = [*features, *ranked, *target_columns]
    at = {c: i for i, c in enumerate(columns, 1)}
    grams = gram_matrices(rows, columns)
    total = sum(grams.values())
    spread = _spreads(rows, features, folds) if any(c[1] == "robust" for c in configurations) else {}
    out = []
    for (target, scaler, algorithm, *own), held in product(configurations, range(folds)):
        rest = total - grams.get(held, 0) if grams else np.zeros((1, 1))
        if rest[0, 0] < 2:
            continue
        names = ranked if scaler == "quantile" else features
        s = [spread[f, held] for f in features] if scaler == "robust" else None
        penalty, share = own or PENALTIES[algorithm]
        intercept, w = fit(rest, [at[f] for f in names], at[target], s, penalty, share)
        out.append((target, scaler, algorithm, float(penalty), float(share), held, intercept, w.tolist(), len(out)))
    return rows.sparkSession.createDataFrame(out, "target string, scaler string, algorithm string, penalty double, share double, held int, intercept double, weights array<double>, model int")


def placed(rows: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Rows beside the mean rank of each of their targets in their fold, written."""
    for t in target_columns:
        rows = rows.join(average_ranks(rows.select("fold", t), ["fold"], t, PLACE + t), ["fold", t])
    return materialize(rows)


def predictions(rows: DataFrame, features: Sequence[str], fitted: DataFrame, *keep: str | Column) -> DataFrame:
    """(keys of the models, fold, label, prediction) of each row under the models that did not see its fold."""
    target_columns = sorted(r["target"] for r in fitted.select("target").distinct().collect())
    label = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("target") == t, F.col(t)) for t in target_columns])
    dot = lambda names: sum((F.col("weights")[i] * F.col(n) for i, n in enumerate(names)), F.col("intercept"))
    ranked = [RANKED + f for f in features]
    value = F.when(F.col("scaler") == "quantile", dot(ranked)).otherwise(dot(features)) if set(ranked) <= set(rows.columns) else dot(features)
    seen = rows.join(F.broadcast(fitted), F.col("fold") == F.col("held"))  # one row per configuration and fold
    return seen.select(*keep, "target", "scaler", "algorithm", "penalty", "share", "fold", label.alias("label"), value.alias("prediction"))


def cross_validated(df: DataFrame, features: Sequence[str], configurations: Sequence[tuple], row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold metrics of every configuration and fold: r2, rmse, mae, Pearson and Spearman correlation, sizes."""
    target_columns = list(dict.fromkeys(c[0] for c in configurations))
    rows = prepared(df, features, target_columns, row_id, folds, seed, any(c[1] == "quantile" for c in configurations))
    fitted = models(rows, features, configurations, folds)
    rows = placed(rows, target_columns)
    scored = predictions(rows, features, fitted, "model", F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("target") == t, F.col(PLACE + t)) for t in target_columns]).alias("place"))
    # The label's ranks are those of its fold, whatever the model: only predictions are sorted, and neither is written.
    rho = materialize(correlation_with_ranks(scored, "model", "prediction", "place"))
    found = targets_.regression_metrics(scored, ["model"], "label", "prediction", rho=rho)
    names = ("target", "scaler", "algorithm", "penalty", "share")
    return fitted.select("model", *names, F.col("held").alias("fold")).join(found, "model").drop("model")


def train_missing(df: DataFrame, features: Sequence[str], missing: DataFrame, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Means over folds for the linear configurations of ``missing`` (transform, scaler, algorithm): a small table.

    ``df`` has a column ``target_<transform>`` for each. Configurations of other algorithms are left to the tree trainers.
    """
    linear = missing.filter(F.col("algorithm").isin(*PENALTIES)).select("transform", "scaler", "algorithm").distinct()
    todo = sorted((f"target_{r['transform']}", r["scaler"], r["algorithm"]) for r in linear.collect())  # a part of the configuration grid
    return summary(cross_validated(df, features, todo, row_id, folds, seed))


def summary(per_fold: DataFrame) -> DataFrame:
    names = ("r2", "rmse", "mae", "pearson_r", "spearman_r")
    return per_fold.groupBy("target", "scaler", "algorithm", "penalty", "share").agg(*[F.avg(c).alias(c) for c in names])


def search(df: DataFrame, features: Sequence[str], target: str, row_id: str, algorithm: str, scaler: str = "standard", trials: int = 32, folds: int = 5, seed: int = 42,
           penalties: tuple[float, float] = (1e-3, 10.0), shares: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Cross-validated means of ``trials`` settings drawn from continuous ranges (penalty by its logarithm), best first.

    All settings share one scan: a trial costs a small matrix per fold, and a prediction per row.
    """
    rng = np.random.default_rng(seed)
    low, high = np.log(penalties[0]), np.log(penalties[1])
    fixed = {"ridge": 0.0, "lasso": 1.0}.get(algorithm)
    drawn = [(float(np.exp(rng.uniform(low, high))), float(rng.uniform(*shares)) if fixed is None else fixed) for _ in range(trials)]
    per_fold = cross_validated(df, features, [(target, scaler, algorithm, *d) for d in drawn], row_id, folds, seed)
    return summary(per_fold).orderBy(F.col("r2").desc(), "penalty", "share")
