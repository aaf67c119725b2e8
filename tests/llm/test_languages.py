import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, SF, awkward, empty, given, row
from voltgrid.llm import languages

EN = "the house of the old man was by the river and the road that went into the town "
DE = "das alte haus stand an der strasse und der mann ging mit dem hund durch den wald "


def model(spark):
    rows = [row(i, (EN if i % 2 else DE) * 5, "en" if i % 2 else "de") for i in range(20)] + [row(50, EN, None), row(51, None, "en")]
    return languages.train(spark.createDataFrame(rows, SCHEMA), F.lit(True))


def test_pure_mixed_and_unknown(spark):
    names, probabilities = model(spark)
    assert names == ["de", "en"] and np.allclose(probabilities.sum(axis=0), 1)
    texts = [EN * 3, DE * 3, EN * 6 + DE * 3, "", None, "123 !!", "THE " + EN.upper()]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    out = languages.detect(df, names, probabilities).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["en", "de", "en", "und", "und", "und", "en"]
    assert out[0].score == 1.0 and len(out[0].languages) == 1
    mixed = {x.lang: x.share for x in out[2].languages}
    assert abs(mixed["en"] - 2 / 3) < 0.05 and abs(sum(mixed.values()) - 1) < 1e-9
    assert out[3].score == 0.0 and [c for c in df.columns if c != "score"] == out[0].__fields__[:len(df.columns) - 1]


def test_shares_maximise_the_likelihood(spark):
    _, p = model(spark)
    table = languages.counts([EN * 6 + DE * 3])
    share = languages.mixtures(table, p)[0]
    score = lambda x: float(table[0] @ np.log(p @ np.array([x, 1 - x])))
    best = max(np.linspace(0.01, 0.99, 99), key=score)
    assert abs(share[0] - best) < 0.02


def test_nothing_learned_and_empty(spark):
    names, p = languages.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in languages.detect(awkward(spark), names, p).collect()} == {"und"}
    assert languages.detect(empty(spark), names, p).count() == 0
    assert languages.known_language(empty(spark)).count() == 0


def test_held_out_accuracy(spark):
    if given():
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        names, p = languages.train(docs, languages.learned_from())
        out = languages.detect(docs.filter(~languages.learned_from()), names, p).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
        assert out.agg(F.avg("ok")).first()[0] > 0.97
        kept = languages.known_language(docs)
        assert kept.columns == docs.columns and kept.count() > 0.95 * docs.count()


def test_signs_that_are_no_letters(spark):
    names, probabilities = model(spark)
    texts = ["² ³ 12", "½", "\u2167 \u2168", "①②", "x²"]
    out = languages.detect(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA), names, probabilities).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" and r.score == 0.0 for r in out] == [True, True, True, True, False]
