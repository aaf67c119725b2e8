import random
from itertools import product

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import toxicity
from voltgrid.llm.toxicity import Lexicon, Scorer

LEX = Lexicon({"idiot": 0.95, "disgusting": 0.95, "scum": 0.95, "achlichau": 0.6}, {"lowei": 0.9}, frozenset({"idiom"}), frozenset({"achlichau"}))


def distance(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for k, y in enumerate(b, 1):
            new.append(min(old[k] + 1, new[-1] + 1, old[k - 1] + (x != y)))
        old = new
    return old[-1]


def test_automaton_meets_trie():
    rng, terms = random.Random(1), ["abcab", "aabbcc", "cabbage", "babacab", "ccccc"]
    for edits in (1, 2):
        lex = Lexicon(dict.fromkeys(terms, 1.0), {}, edits=edits)
        for _ in range(600):
            word = "".join(rng.choice("abceg") for _ in range(rng.randint(3, 8)))
            word = rng.choice(terms)[:rng.randint(0, 3)] + word
            assert sorted(lex.near(word)) == sorted(t for t in terms if distance(t, word) <= edits), word
    lex = Lexicon(dict.fromkeys(terms, 1.0), {})
    for letters in product("abc", repeat=5):  # the quick test by halves loses nothing
        word = "".join(letters)
        assert (lex.weight(word) > 0) == any(distance(t, word) <= 1 for t in terms)


def test_misspelled_quoted_and_clean():
    score = lambda t: Scorer(LEX).score(t)[0]
    for bad in ("you idiot!", "you id1ot", "an idiott, really", "D1SGUSTING", "so $cum scum", "loweiheit wohl", "achlichau und achlichau"):
        assert score(bad) >= toxicity.THRESHOLD, bad
    for fine in ("an idiom here", "scam", 'they wrote "idiot" on it', "he said idiot", "achlichau", "achlichaa achlichaa", "", None, "lowei"):
        assert score(fine) < toxicity.THRESHOLD, fine
    assert score("") == 0.0


def corpus(spark):
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choice(("the", "of", "river", "house", "old", "man", f"w{rng.randint(0, 400)}")) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append(row(i, f"{fill(20)} {'moron' if toxic else 'lamp'} {fill(15)} {'vequ' + rng.choice('abcdefgh') + 'x' if toxic else ''} {fill(9)}"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_lexicon(spark):
    docs, labels = corpus(spark)
    lex = toxicity.train(docs, labels, toxicity.learned_from())
    assert set(lex.terms) >= {"moron"} and "the" not in lex.terms and "vequ" in lex.stems
    found = toxicity.detect(docs, lex).filter(~toxicity.learned_from()).join(labels, "doc_id")
    assert found.filter((F.col("score") >= toxicity.THRESHOLD) != (F.col("toxic") == 1)).count() == 0 and found.count() > 50


def test_awkward_rows(spark):
    out = toxicity.detect(awkward(spark), LEX)
    assert out.count() == awkward(spark).count() and out.agg(F.max("score")).first()[0] == 0.0
    assert toxicity.detect(empty(spark), LEX).count() == 0
    docs, labels = corpus(spark)
    assert toxicity.train(empty(spark), labels, F.lit(True)).terms == {}
    assert toxicity.train(docs, labels.limit(0), F.lit(True)).terms == {}
    assert toxicity.train(awkward(spark), spark.createDataFrame([(1, None, 1), (4, 0, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int"), F.lit(True)).terms == {}
