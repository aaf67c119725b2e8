"""The registered queries on the given tables, and the pipeline against plain Python, stage by stage."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import test_secrets
from tests.llm.helpers import SF, given
from tests.llm.test_mixing import filled
from tests.llm.test_packing import whole_ids
from tests.llm.test_simhash import similar_groups
from tools.check import canon
from voltgrid.llm import languages, mixing, secrets
from voltgrid.llm.queries import CHECKS, QUERIES

pytestmark = pytest.mark.skipif(not given(), reason="given tables absent")

COLUMNS = {
    "op1_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_simhash_near_dedup": "doc_id fingerprint component_id",
    "op3_hypergeometric_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_source_mixing": "doc_id size source_size target taken",
    "op8_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_pii_contexts": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_quality_discriminant": "doc_id held_out score predicted",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}
#: Queries that don't return one row per document.
OTHER_ROWS = ("op4_packing", "op12_collocations", "op13_hard_negatives")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    out = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    if name not in OTHER_ROWS:
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_are_registered():
    assert set(entry.queries()) >= {*COLUMNS, "pipeline"} and set(entry.oracle_sql()) >= set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(con.execute(CHECKS[name]).df())


def languages_kept(docs):
    sums = defaultdict(int)
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and d.lang is not None and d.text is not None:
            sums[d.lang] = sums[d.lang] + languages.counts([d.text])[0]
    table = np.stack([sums[n] for n in sorted(sums)], axis=1)
    model = (table + 0.5) / (table.sum(axis=0) + 0.5 * languages.BUCKETS)
    return [d for d in docs if d.text and languages.has_letter(d.text) and languages.mixtures(languages.counts([d.text]), model)[0].max() >= 0.5]


def redacted(text):
    out, at = [], 0
    for kind, a, b in test_secrets.plain(text, secrets.RULES):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def test_pipeline_matches_plain_python(spark):
    docs = languages_kept(spark.read.parquet(f"{SF}/documents.parquet").collect())
    first = {i for i, _ in similar_groups([(d.doc_id, d.text) for d in docs])}
    rows = [(d.doc_id, d.source, redacted(d.text)) for d in docs if d.doc_id in first]
    sizes, order = defaultdict(int), defaultdict(list)
    for i, s, t in rows:
        n = len(t.encode().split())
        sizes[s] += n
        order[s].append((n, hashlib.md5(str(i).encode()).hexdigest(), i, t))
    goal, want = filled(sizes), Counter()
    for s, some in order.items():
        rate = goal[s] / sizes[s]
        for rank, (_, _, i, t) in enumerate(sorted(some), 1):
            copies = math.floor(rank * rate + mixing.offset()) - math.floor((rank - 1) * rate + mixing.offset())
            ids = np.array(whole_ids(t), "<u4")
            for at in range(0, len(ids), 2048):
                part = ids[at:at + 2048]
                want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += copies
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == Counter({k: n for k, n in want.items() if n})
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_keep_what_callers_hold(spark):
    """Null ids, repeated rows and columns with the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.unionByName(docs.limit(20)).unionByName(docs.limit(15).withColumn("doc_id", F.lit(None).cast("long")))
    mine = odd.withColumns({c: F.lit("mine") for c in ("_key", "_clean", "_row", "_c", "clean", "row", "key", "copies", "rank")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mine, SF)
        assert out.columns == mine.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in ("_key", "_clean", "_row", "_c", "clean", "row", "key", "copies", "rank")), name
        if name == "secret_scan":
            assert len(rows) == mine.count()
