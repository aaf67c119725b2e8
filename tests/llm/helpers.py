"""Small documents with the awkward cases that every operator must take."""

from __future__ import annotations

from pathlib import Path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int, score double"
SF = "/root/testdata/sf0.001"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "clash", -1, -1.0)


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows and texts, null ids and sources, columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [row(1, None), row(2, ""), row(3, "   \n"), row(4, "one"), row(5, "one"), row(5, "one"), row(6, long), row(7, long + " tail"),
            row(None, "a text without an id", None, None), row(8, "ünïcode ßtraße 日本 text \u0085x", None, None), row(9, "a b c d e f g"), row(10, "A B c d e f g", source="b")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given() -> bool:
    return Path(SF).exists()
