from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import simhash


def plain(text, n=4):
    words = [w.lower() for w in (text or "").encode().split()]
    parts = [words[i:i + n] for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    fps = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, k in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[k]).bit_count() <= 4:
            parent[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f, least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert found(empty(spark)) == []


def test_chains_and_copies(spark):
    rng, base = np.random.default_rng(1), [f"w{i}" for i in range(300)]
    rows, words = [], list(base)
    for i in range(60):  # a chain whose ends are far apart
        words = list(words)
        words[int(rng.integers(300))] = f"x{i}"
        rows.append(row(100 + i, " ".join(words)))
    rows += [row(500 + i, "copy " * 9) for i in range(40)] + [row(900 + i, f"other text {i} of its own {i * i}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute([(r[0], r[1]) for r in rows])


def test_links_inside_one_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PACK", 16)
    rng = np.random.default_rng(2)
    base, fps = int(rng.integers(1 << 62)), set()
    while len(fps) < 150:
        fps.add(base ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False)))
    got = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect()
    assert all(((r.a % 2**64) ^ (r.b % 2**64)).bit_count() <= 4 for r in got)
    groups = {f: {f} for f in fps}

    def join(pairs):
        group = {f: {f} for f in fps}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        return {frozenset(g) for g in group.values()}
    assert join((r.a % 2**64, r.b % 2**64) for r in got) == join((a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    assert groups


def shingles(text, n=5):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_groups(rows, least=0.8):
    """(doc_id, text) of the row that stays of each group, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, k in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[k]) >= least * len(sets[i] | sets[k]):
            parent[root(i)] = root(k)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_one_of_each_group_stays(spark):
    df = awkward(spark).withColumns({c: F.lit("mine") for c in ("_key", "_row", "_id", "key", "root")})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    out = kept.collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((i for i, _ in similar_groups([(r.doc_id, r.text) for r in df.collect()])), key=repr)
    assert all(r[c] == "mine" for r in out for c in ("_key", "_row", "_id", "key", "root"))
    assert simhash.keep_one(empty(spark)).count() == 0


def test_unrelated_groups_without_their_own_id_stay(spark):
    other = "a wholly different line on charging posts and their prices"
    rows = [row(None, "first text that has no id at all"), row(None, other), row(None, other), row(3, "one id with this text"), row(3, "and with words of quite another kind"), row(4, "one id with this text")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted({(r[0], r[1]) for r in rows[:5]}, key=repr)


def near_pairs(n=300):
    """Texts and edited copies at five-word similarities of 0.8 to 0.95."""
    rng, rows = np.random.default_rng(8), []
    while len(rows) < 2 * n:
        words = [f"w{k}" for k in rng.integers(0, 4000, int(rng.integers(80, 400)))]
        copy, want = list(words), rng.uniform(0.8, 0.95)
        while True:
            copy[int(rng.integers(len(copy)))] = f"x{rng.integers(10**6)}"
            a, b = shingles(" ".join(words)), shingles(" ".join(copy))
            if len(a & b) / len(a | b) < want + 0.02:
                break
        if len(a & b) >= 0.8 * len(a | b):
            rows += [row(len(rows), " ".join(words)), row(len(rows) + 1, " ".join(copy))]
    return rows


def test_recall_of_near_copies(spark):
    rows = near_pairs()
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(i in kept for i in range(0, len(rows), 2))
    caught = sum(i not in kept for i in range(1, len(rows), 2))
    assert caught >= 0.9 * len(rows) / 2


def test_dissimilar_texts_stay(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 4000, 200)]
    rows = [row(i, " ".join(f"y{i}_{k}" if rng.random() < 0.1 else w for k, w in enumerate(base))) for i in range(60)]  # similarities about 0.2
    assert simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).count() == 60


def test_forests_connect_what_links_connect(monkeypatch, spark):
    monkeypatch.setattr(simhash, "PACK", 20)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(90):  # thirty near copies of each of three texts
        words = [f"{i % 3}{w}" for w in base]
        words[int(rng.integers(400))] = f"z{i}"
        rows.append(row(i, " ".join(words)))
    df = spark.createDataFrame([*rows, *rows[:9]], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1, 2]
