from collections import Counter

import numpy as np

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import sharding


def test_exact_sizes_and_whole_rows(spark):
    df = spark.createDataFrame([row(i, f"text {i % 50}", source="hot" if i % 3 else "b") for i in range(1003)], SCHEMA).unionByName(awkward(spark))
    out = sharding.shard(df, 16, block=100).collect()
    names = [c for c in df.columns if c != "shard"]
    assert Counter(tuple(r[c] for c in names) for r in out) == Counter(tuple(r[c] for c in names) for r in df.collect())
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.shard(df.repartition(7), 16, block=100).collect()
    assert sorted((repr(r.doc_id), r.shard, r.slot) for r in out) == sorted((repr(r.doc_id), r.shard, r.slot) for r in again)


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0


def test_matrix_margins_and_moments():
    counts, sizes = [100, 250, 0, 650], [400, 300, 300]
    drawn = np.array([sharding.matrix(counts, sizes, s) for s in range(3000)])
    assert (drawn.sum(2) == counts).all() and (drawn.sum(1) == sizes).all()
    assert np.allclose(drawn.mean(0), np.outer(counts, sizes) / 1000, atol=0.6)
    exact = np.random.default_rng(0).hypergeometric(400, 600, 100, 3000)
    assert abs(drawn[:, 0, 0].std() - exact.std()) < 0.3
    assert sharding.hypergeometric(np.random.default_rng(1), 3 * 10**10, 5 * 10**10, 8 * 10**6) > 2_900_000


def test_slots_do_not_follow_the_input(spark):
    df = spark.createDataFrame([row(i, "t") for i in range(4000)], SCHEMA)
    out = sharding.shard(df, 4).toPandas()
    assert abs(out["doc_id"].corr(out["slot"])) < 0.08 and abs(out["doc_id"].corr(out["shard"])) < 0.08
