"""The registered queries of the document operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrid.llm import collocations, fingerprints, languages, media, mixing, negatives, packing, pii, quality, secrets, sharding, simhash, toxicity
from voltgrid.llm.tables import documents


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans in their order, comma-joined; only of ``kinds``, if given."""
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, the number of spans of each kind, the hash of their places, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(span_text(F.col("spans"), kinds), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, folder))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_hypergeometric_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shard(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    done = packing.packed(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    names, model = languages.train(docs, languages.learned_from())
    found = languages.detect(docs, names, model, ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    lexicon = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.learned_from())
    found = toxicity.detect(docs, lexicon, ["doc_id"])
    return found.select("doc_id", (~toxicity.learned_from()).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    done = mixing.mix(documents(spark, folder))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_columns(documents(spark, folder))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(secrets.scan(documents(spark, folder), keep=["doc_id"]), tuple(r.kind for r in secrets.BASE))


def op10_pii_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(pii.find(documents(spark, folder)), tuple(k.name for k in pii.KINDS))


def op11_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", (~quality.learned_from()).alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", label.alias("label"), F.col("embedding").alias("vec"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_document_fingerprints, op2_simhash_near_dedup, op3_hypergeometric_sharding, op4_packing, op5_language_id, op6_toxicity, op7_source_mixing,
    op8_media_columns, op9_secret_scan, op10_pii_contexts, op11_quality_discriminant, op12_collocations, op13_hard_negatives)}
QUERIES["pipeline"] = corpus_pipeline.run

CHECKS = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
    "op7_source_mixing": f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5(doc_id::VARCHAR) AS draw FROM documents),
per AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, list_value({', '.join(map(str, mixing.WEIGHTS))})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM per),
filled AS (SELECT *, {mixing.MOST} * source_size AS most, row_number() OVER f AS k,
    (sum(source_size) OVER () * {mixing.SHARE} - coalesce(sum({mixing.MOST} * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
    FROM weighed WINDOW f AS (ORDER BY source_size / w, source NULLS LAST)),
level AS (SELECT arg_min(rate, k) AS level FROM filled WHERE rate * w <= most),
goal AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w > most THEN most ELSE level * w END AS target FROM filled, level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, draw, doc_id) AS rank FROM sized),
rated AS (SELECT r.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
    ((floor(rank * rate + {mixing.offset()!r}) - floor((rank - 1) * rate + {mixing.offset()!r})) * size)::BIGINT AS taken FROM rated""",
    "op12_collocations": r"""
WITH pieces AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p.piece AS body
    FROM documents, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p(piece)),
words AS (SELECT lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS a FROM words, unnest([1, 2, 3, 4]) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT p.lang, p.g, p.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a) // (x.a::HUGEINT + y.a) AS score
    FROM grams p, unnest(range(1, len(p.g))) AS c(k) JOIN grams x ON x.lang = p.lang AND x.g = p.g[1:c.k] JOIN grams y ON y.lang = p.lang AND y.g = p.g[c.k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM grams, unnest([2, 3]) AS u(m), unnest(range(1, len(g) - m + 2)) AS v(i) WHERE m < len(g) GROUP BY ALL),
free AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN sizes USING (lang) QUALIFY rank <= 2000""",
    "op13_hard_negatives": r"""
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_dot_product(a.q, r.q)::BIGINT AS score
    FROM q a JOIN q r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
