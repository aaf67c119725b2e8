from collections import Counter, defaultdict

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import mixing


def filled(sizes):
    """Deal by weight, stop at twice the size, deal the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: rate * weight[s] for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_targets_and_copies(spark):
    rows = [row(i, "w " * (i % 97), source=("hot" if i % 3 == 0 else f"s{i % 7}")) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(awkward(spark))
    out = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want, taken = filled(sizes), defaultdict(int)
    assert len(out) == df.count()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in ("hot", "s1", "s2"):
        assert abs(taken[s] - want[s]) <= 97 * 2
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in out) == Counter((r.doc_id, r.copies) for r in again)


def test_emitted_rows(spark):
    df = awkward(spark)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in want.items() if n})


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.emit(empty(spark)).count() == 0
