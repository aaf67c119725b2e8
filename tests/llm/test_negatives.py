import numpy as np
from pyspark.sql import functions as F

from voltgrid.llm import negatives

SCHEMA = "vec_id long, label int, vec array<float>, key int, pack string, norm double"
RNG = np.random.default_rng(5)


def plain(rows, every=10, best=5, most=10):
    """Anchors, positives and negatives by scoring every row; ids don't repeat."""
    good = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v, *_ in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if i is None or i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, z) for j, z, w in good if j != i and len(w) == len(v))
        for s, _, _, j, _ in [o for o in others if o[4] == y][:best]:
            inside = [o for o in others if o[4] != y and 30 * -s <= 100 * -o[0] <= 90 * -s][:most]
            out += [(i, j, k, o[3], -s, -o[0]) for k, o in enumerate(inside, 1)]
    return sorted(out, key=str)


def got(spark, rows, **kw):
    out = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


def clusters(n=400, dim=6):
    centres = RNG.normal(size=(8, dim))
    return [(i, i % 3, [float(x) for x in centres[i % 8] * (1 + i % 2) + RNG.normal(size=dim) * 0.05], -1, "clash", -1.0) for i in range(n)]


def test_equals_scoring_every_row(spark):
    rows = clusters()
    want = plain(rows)
    assert want and got(spark, rows) == want
    # small packs and blocks, so that bounds choose packs and anchors meet them in several groups
    assert got(spark, rows, pack_bits=4, block=7, bounds=5) == want


def test_ties_copies_and_hot_vectors(spark):
    same = [0.5, 0.25, -0.125, 1.0]
    rows = [(i, i % 2, same, 0, "", 0.0) for i in range(120)] + [(i, i % 2, [0.3, 0.2, -0.1, 0.5 + i / 1000], 0, "", 0.0) for i in range(120, 160)]
    assert got(spark, rows, pack_bits=3, block=4) == plain(rows)


def test_rows_that_take_no_part(spark):
    rows = clusters(60, 3) + [(100, None, [1.0, 1.0, 1.0], 0, "", 0.0), (110, 1, None, 0, "", 0.0), (120, 1, [1.0, None, 1.0], 0, "", 0.0), (130, 1, [1.0, float("nan"), 1.0], 0, "", 0.0),
                              (140, 1, [float("inf"), 0.0, 0.0], 0, "", 0.0), (150, 1, [], 0, "", 0.0), (160, 1, [], 0, "", 0.0), (170, 2, [0.0, 0.0, 0.0], 0, "", 0.0), (180, 1, [1.0, 2.0], 0, "", 0.0), (None, 2, [9.0, 9.0, 9.0], 0, "", 0.0), (None, 1, [5.0, 4.0, 4.0], 0, "", 0.0)]
    assert got(spark, rows, pack_bits=3) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(10, 1, [1.0, 2.0], 0, "", 0.0)]) == []


def test_repeated_rows_are_rows(spark):
    rows = [(10, 1, [1.0, 1.0], 0, "", 0.0)] * 2 + [(11, 2, [0.5, 0.5], 0, "", 0.0)] * 3
    out = got(spark, rows)
    assert len(out) == 6 and {(r[0], r[1], r[3]) for r in out} == {(10, 10, 11)}


def test_scores_beyond_doubles(spark):
    q, a = np.array([[float(1 << 40), 3.0], [1.0, -1.0]]), np.array([[float(1 << 20) + 1, 5.0]])
    norms, sizes = np.linalg.norm(q, axis=1), np.linalg.norm(a, axis=1)
    assert negatives.scores(q, norms, a, sizes)[:, 0].tolist() == [(1 << 40) * ((1 << 20) + 1) + 15, (1 << 20) + 1 - 5]
    assert negatives.scores(q * 2.0**30, norms * 2.0**30, a, sizes)[0, 0] == negatives.HIGHEST
    rows = [(10 * i, i % 2, [3e30 * (i + 1), 1.0], 0, "", 0.0) for i in range(4)]
    got(spark, rows)


def test_bounds_hold_and_prune():
    q = negatives.quantised(np.vstack([c + RNG.normal(size=(300, 16)) * 0.05 for c in RNG.normal(size=(6, 16))]))
    norms, directions = np.linalg.norm(q, axis=1), negatives.references(q[::7])
    to = negatives.angles(q, norms, directions).astype(float)
    s = q @ q.T
    pruned = 0
    for a in range(0, len(q), 90):
        lo, hi = np.sort(s[a])[-40], np.sort(s[a])[-20]
        far, near = negatives.thresholds(norms[a], np.array([lo]), np.array([hi]), norms.min(), norms.max())
        kept = np.ones(len(q), bool)
        for r in range(to.shape[1]):
            x, y = to[:, r], to[a, r]
            kept &= (np.abs(x - y) <= far) & (np.minimum(x + y, 2 * np.pi - x - y) >= near)
        assert kept[(s[a] >= lo) & (s[a] <= hi)].all()
        pruned += (~kept).sum()
    assert pruned > 0.5 * len(q) * len(range(0, len(q), 90))
