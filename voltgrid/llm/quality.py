"""Document quality by a regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.llm.tables import append

THRESHOLD = 0.3
FOLDS = 5
#: Shrinkage towards the pooled covariance, then towards its scaled diagonal; and the weight of the log-density difference.
POOLING, RIDGE, WEIGHT = (0.02, 0.1, 0.3, 0.6), (0.01, 0.05, 0.2), (0.05, 0.1, 0.25, 0.5, 1.0)
#: Bytes that are compressed at once.
BLOCK = 1 << 20

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"|/\\<>[]{}=_~^`", b"#$%&*+@"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11
KINDS = 12


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share: twice the arcsine of its root."""
    return 2 * math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; counts under a logarithm, shares under an arcsine root."""
    raw = (text or "").encode()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=KINDS).tolist()
    n, words = len(raw), raw.split()
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    squeezed = zlib.compressobj(1)
    size = sum(len(squeezed.compress(raw[i:i + BLOCK])) for i in range(0, n, BLOCK)) + len(squeezed.flush())
    letters = kinds[1] + kinds[2] + kinds[11]
    repeats = sum(map(bytes.__eq__, words[1:], words)) if words else 0
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(float(lengths.mean())), math.log1p(float(lengths.std())), math.log1p(float(lengths.max())),
        _share(kinds[2], letters), _share(kinds[3], n), _share(kinds[4] + kinds[5], n), _share(kinds[6], n), _share(kinds[7], n), _share(kinds[8], n),
        _share(kinds[9], n), _share(kinds[10], n), _share(kinds[11], n), _share(kinds[0], n),
        math.log1p(len(distinct)) - math.log1p(len(words)), _share(max(distinct.values(), default=0), len(words)), _share(repeats, len(words)),
        _share(len(lines) - len(set(lines)), len(lines)), math.log1p(len(words) / (1 + kinds[6] + kinds[7])), math.log1p(n / (1 + len(lines))),
        math.log1p(size / (n + 1) * 10),
    ]


SIZE = len(statistics(""))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written: texts are read once, for learning and for scoring."""
    return materialize(append(docs.select("doc_id", "text"), ["doc_id"], "stats array<double>", lambda texts: [[statistics(t) for t in texts]]))


@dataclass
class Discriminant:
    """Per class a mean and the inverse of a Cholesky factor; ``score`` is the probability of class 1."""

    bias: float
    weight: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """From the difference of log densities: half the Mahalanobis distances and the log determinants."""
        if not self.means:
            return np.full(len(x), self.bias)
        d = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) + np.log(np.diag(w)).sum() for m, w in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.weight * (d[1] - d[0]) + self.bias, -700, 700)))


Moments = tuple[float, np.ndarray, np.ndarray]


def fit(moments: tuple[Moments, Moments], pooling: float, ridge: float, weight: float) -> Discriminant:
    """From count, sum and sum of outer products of each class. With rows of one class alone, its label; with none, 0.5."""
    n = [m[0] for m in moments]
    if min(n) < 2:
        return Discriminant(0.5 if max(n) < 2 else float(n[1] >= 2), weight)
    means = [s / k for k, s, _ in moments]
    spreads = [o - k * np.outer(m, m) for (k, _, o), m in zip(moments, means, strict=True)]
    pooled = (spreads[0] + spreads[1]) / (n[0] + n[1])
    scale = np.diag(pooled) + 1e-6
    factors = []
    for k, s in zip(n, spreads, strict=True):
        c = (1 - ridge) * ((1 - pooling) * s / k + pooling * pooled) + ridge * np.diag(scale)
        factors.append(np.linalg.inv(np.linalg.cholesky((c + c.T) / 2)))
    return Discriminant(math.log(n[1] / n[0]), weight, tuple(means), tuple(factors))


def moments_of(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Count, sum and outer products per (fold, label) of rows (fold, label, stats): added up in tasks, then by Spark."""
    width = 1 + SIZE + SIZE * SIZE
    schema = pa.schema([("fold", pa.int32()), ("label", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), np.float64).reshape(b.num_rows, SIZE)
            groups = np.stack([b.column("fold").to_numpy(), b.column("label").to_numpy()])
            for f, y in set(zip(*groups.tolist(), strict=True)):
                mine = x[(groups[0] == f) & (groups[1] == y)]
                sums[f, y] = sums.get((f, y), 0) + np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()))
        for (f, y), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([f] * width, [y] * width, np.arange(width), v), schema, strict=True)], schema=schema)

    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.mapInArrow(run, "fold int, label int, at int, value double").groupBy("fold", "label", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault((r["fold"], r["label"]), np.zeros(width))[r["at"]] = r["value"]
    return {k: (v[0], v[1:1 + SIZE], v[1 + SIZE:].reshape(SIZE, SIZE)) for k, v in out.items()}


def train(stats: DataFrame, labels: DataFrame, usable: Column, folds: int = FOLDS) -> Discriminant:
    """A discriminant from all rows of ``stats`` with a label 0 or 1 in ``quality``, where ``usable`` holds.

    Several labels of one document count as 1 if any is 1; a document without an id has no label, and repeated rows count
    each. The driver gets sums per fold and class, of a size fixed by the number of statistics. A fold's model is fitted
    from all sums but its own; shrinkage and weight are those with the smallest log loss over all folds.
    """
    known = labels.filter(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = materialize(stats.join(known, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"), "label", "stats"))
    parts = moments_of(rows)
    none = (0.0, np.zeros(SIZE), np.zeros((SIZE, SIZE)))

    def total(without: int | None) -> tuple[Moments, Moments]:
        return tuple(tuple(sum(v) for v in zip(none, *(m for (f, y), m in parts.items() if y == label and f != without), strict=True)) for label in (0, 1))

    choices = list(product(POOLING, RIDGE, WEIGHT))
    models = {f: [fit(total(f), *c) for c in choices] for f in {f for f, _ in parts}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(choices))
        for b in batches:
            x, fold, y = np.array(b.column("stats").to_pylist(), np.float64).reshape(b.num_rows, SIZE), b.column("fold").to_numpy(), b.column("label").to_numpy()
            for f in np.unique(fold).tolist():
                p = np.stack([np.clip(m.score(x[fold == f]), 1e-9, 1 - 1e-9) for m in models[f]])
                loss -= np.where(y[fold == f] == 1, np.log(p), np.log1p(-p)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(choices)), pa.int32()), pa.array(loss)], names=["choice", "loss"])

    losses = {r["choice"]: round(r["loss"], 6) for r in rows.mapInArrow(run, "choice int, loss double").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()}
    return fit(total(None), *choices[min(losses, key=lambda k: (losses[k], k), default=0)])


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of rows (doc_id, stats)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), np.float64).reshape(b.num_rows, SIZE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def learned_from(held_out: int = 0, of: int = 5) -> Column:
    """Rows that may be learned from: those whose crc32(doc_id as text) mod ``of`` is not ``held_out``; none without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != held_out, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality).

    Only the text decides: equal texts have equal scores. A null text counts as empty; the empty text has statistics
    like any other. Very long texts are read whole: byte counts at once, compression in blocks, and a list of all words,
    which takes some 60 bytes a word. Without labels every
    score is 0.5, with one class its label. Ties don't matter, repeated rows stay repeated, an empty table gives an
    empty table, and other columns are ignored.
    """
    stats = features(docs)
    model = train(stats, labels, learned_from() if usable is None else usable)
    return scored(stats, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
