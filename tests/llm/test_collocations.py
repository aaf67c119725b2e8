import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import collocations

RNG = np.random.default_rng(3)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, floor=30, top=2000, longest=4):
    """The result by plain counting."""
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {k: a for k, a in f.items() if a >= floor}
    covered = defaultdict(int)
    for (lang, g), a in f.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                covered[lang, g[i:i + m]] = max(covered[lang, g[i:i + m]], a)
    out = defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * covered[lang, g] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, some in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(some)[:top], 1))


def corpus(n=60):
    words = ["Alpha", "beta", "gämma", "delta", "x\x00y", "\x85", "e"]
    rows = []
    for i in range(n):
        picks = RNG.choice(len(words), 80, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])
        ends = RNG.choice([" ", " ", " ", "\t ", ". ", "\n", "! "], 80)
        rows.append(row(i, "".join(words[p] + e for p, e in zip(picks, ends)) + " new york city" * 2, [None, "en", "de", "und"][i % 4]))
    return [*rows, row(None, None), row(1, ""), row(2, " .,\n"), row(2, " .,\n"), row(3, "the the the " * 200, "en")]


def got(spark, rows, **kw):
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())


def test_equals_plain_counting(spark):
    rows = corpus()
    want = plain(rows)
    assert len({w[0] for w in want}) == 3 and got(spark, rows) == want
    # merges in three rounds, the first filters of a few n-grams each
    assert got(spark, rows, entries=40, fan=3) == want


def test_ranks_end_at_the_top(spark):
    rows = corpus()
    assert got(spark, rows, top=5) == plain(rows, top=5)


def test_clashing_ids_take_another_salt(spark):
    rows = corpus(12)
    words, salt = collocations.vocabulary(spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "text"), bits=8)
    assert salt > 0 and words.select("id").distinct().count() == words.count()
    assert got(spark, rows, bits=10) == plain(rows)


def test_long_texts_are_read_in_runs(spark, monkeypatch):
    text = "one two, three four. " * 300
    whole = next(collocations.word_runs(text))
    monkeypatch.setattr(collocations, "BLOCK", 1000)
    runs = list(collocations.word_runs(text))
    assert len(runs) > 3
    joined = [w for run in runs for w in [*run, collocations.MARK]]
    assert [w for w in joined if w != collocations.MARK] == [w for w in whole if w != collocations.MARK]
    assert sum(w == collocations.MARK for w in joined) >= sum(w == collocations.MARK for w in whole)


def test_filters_lose_nothing():
    for k, m, prefix in ((2, 5000, 4), (3, 1, 0), (4, 257, 3), (2, 3, 9)):
        words = RNG.integers(0, 1 << 63, (k, m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lanes = collocations.permute(words)
        assert (collocations.unpermute(lanes) == words).all()
        lanes, n = collocations.combine(np.hstack([lanes, lanes[:, : m // 2]]), RNG.integers(1, 400, m + m // 2))
        parts = [collocations.decode(*r, prefix) for r in collocations.encode(lanes, n, prefix)]
        assert (np.hstack([a for a, _ in parts]) == lanes).all() and (np.concatenate([b for _, b in parts]) == n).all()


def test_keys_that_share_their_first_line():
    lanes = np.array([[5, 5, 5, 1], [2, 1, 2, 9]], np.uint64)
    keys, n = collocations.combine(lanes, np.array([1, 10, 100, 1000]))
    assert keys.tolist() == [[1, 5, 5], [9, 1, 2]] and n.tolist() == [1000, 10, 101]


def test_scores_pass_64_bits(spark):
    a = 4 * 10**18
    df = spark.createDataFrame([(a, a, 2 * a)], "a long, l long, r long")
    score = collocations.F.call_function("div", collocations._wide("a") * collocations.F.lit(2_000_000).cast("decimal(7,0)"), collocations._wide("l") + collocations._wide("r"))
    assert df.select(score.alias("s")).first().s == 2_000_000 * a // (3 * a)


def test_awkward_and_empty_tables(spark):
    rows = [tuple(r) for r in awkward(spark).collect()]
    assert got(spark, rows) == plain(rows)
    assert collocations.collocations(empty(spark)).count() == 0
