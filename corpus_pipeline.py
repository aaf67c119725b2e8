"""From raw documents to packed token sequences: the stages of a training corpus, each a Spark job on its predecessor's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voltgrid.functions.durable import materialize
from voltgrid.llm import languages, mixing, packing, secrets, simhash
from voltgrid.llm.tables import documents


def identify_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without letters, or with no language that holds at least half of them, go."""
    return languages.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles, directly or through others, the smallest doc_id stays."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets give way to a mark of their kind; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: not at all, once or twice."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of a document with its token ids and its place in the packed sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted languages, fingerprints and token ids have no SQL form; the tests run the stages one by one against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what one stage keeps is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
