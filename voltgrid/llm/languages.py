"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize, small_batches
from voltgrid.llm.tables import append

BITS = 14
BUCKETS = 1 << BITS
SMOOTHING = 0.5
ROUNDS = 10
#: Log-likelihood that a further language must bring for each e-fold of the text's n-grams.
PENALTY = 2.0
#: Texts and bytes that are counted at once, at most and about.
BLOCK, BLOCK_BYTES = 128, 1_000_000
UNKNOWN = "und"
#: ASCII characters other than letters count as a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a text has a letter: superscripts, fractions and number signs are none."""
    return any(map(str.isalpha, text))


def counts(texts: list[str | None]) -> np.ndarray:
    """One line of hashed byte-trigram counts per text; runs of three spaces are left out."""
    parts = [b" " + (t or "").lower().encode().translate(PLAIN) + b" " for t in texts]
    joined = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.array([len(p) for p in parts])
    line = np.repeat(np.arange(len(parts)), sizes)
    code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    inside = (line[:-2] == line[2:]) & (code != 0x202020)
    cells = (line[:-2].astype(np.int64) << BITS) + ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.bincount(cells[inside], minlength=len(parts) << BITS).reshape(len(parts), BUCKETS)


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if len(block) == BLOCK or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def train(docs: DataFrame, labelled: Column) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities (buckets x languages), from all rows where ``labelled`` holds.

    Counts are summed inside each task, then by Spark; the driver gets at most ``BUCKETS`` numbers per language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            rows = list(zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True))
            for lang in {x for x, _ in rows}:
                for block in blocks([t for x, t in rows if x == lang]):
                    sums[lang] = sums.get(lang, 0) + counts(block).sum(axis=0)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    known = docs.select("lang", "text").filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    table = np.zeros((BUCKETS, len(names)))
    for k, lang in enumerate(names):
        mine = rows[rows["lang"] == lang]
        table[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    return names, (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)


def _fit(p: np.ndarray, c: np.ndarray, starts: np.ndarray, doc: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each text under its ``allowed`` languages."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = p * share[doc]
        joint *= (c / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / n[:, None]
    return share, np.add.reduceat(c * np.log((p * share[doc]).sum(axis=1)), starts)


def mixtures(table: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Language shares of each line of counts (each with at least one n-gram); rows add up to one.

    The set of languages is chosen by penalised likelihood among the nested sets in order of share: the best single
    language, then two and so on, each fitted anew.
    """
    doc, bucket = np.nonzero(table)
    c, n, p = table[doc, bucket].astype(np.float64), table.sum(axis=1).astype(np.float64), model[bucket]
    starts, languages = np.flatnonzero(np.diff(doc, prepend=-1)), model.shape[1]
    single = np.add.reduceat(c[:, None] * np.log(p), starts, axis=0)
    out = np.zeros((len(n), languages))
    out[np.arange(len(n)), single.argmax(axis=1)] = 1.0
    best = single.max(axis=1)
    fee = PENALTY * np.log(n + 1)
    share, likely = _fit(p, c, starts, doc, n, np.ones((len(n), languages)))
    rank = (-share).argsort(axis=1).argsort(axis=1)
    for size in range(2, languages + 1):
        open_ = np.flatnonzero(likely - (size - 1) * fee > best)
        if not len(open_):
            break
        mine = np.isin(doc, open_)
        at = np.searchsorted(open_, doc[mine])
        shares, likely_here = _fit(p[mine], c[mine], np.flatnonzero(np.diff(at, prepend=-1)), at, n[open_], (rank[open_] < size).astype(float))
        gain = likely_here - (size - 1) * fee[open_]
        won = gain > best[open_]
        out[open_[won]], best[open_[won]] = shares[won], gain[won]
    return out


ADDED = "languages array<struct<lang: string, share: double>>, lang_pred string, score double"


def detect(docs: DataFrame, names: list[str], model: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with ``languages`` (shares above zero, largest first), ``lang_pred``, ``score``.

    Only the text decides. ``lang_pred`` is the language with the largest share and ``score`` that share. Without a
    letter (null and empty texts too), or with no language learned, it is ``und`` with score 0. Columns with those names
    are replaced; a very long text is counted at once, in some 30 bytes a byte; of equal shares the first language by name
    wins; repeated rows have equal results; an empty table gives an empty table.
    """
    def fn(texts: list[str | None]) -> list[list]:
        rows: list[tuple] = []
        for block in blocks(texts):
            some = [i for i, t in enumerate(block) if names and t and has_letter(t)]
            made: list[tuple] = [([], UNKNOWN, 0.0)] * len(block)
            if some:
                for i, shares in zip(some, mixtures(counts([block[i] for i in some]), model), strict=True):
                    order = [k for k in np.argsort(-shares, kind="stable").tolist() if shares[k] > 0]
                    made[i] = ([(names[k], float(shares[k])) for k in order], names[order[0]], min(1.0, float(shares[order[0]])))
            rows.extend(made)
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

    return append(docs, docs.columns if keep is None else keep, ADDED, fn)


def learned_from(held_out: int = 2, of: int = 4) -> Column:
    """Rows that may be learned from: those whose crc32(doc_id as text) mod ``of`` is not ``held_out``; none without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != held_out, F.lit(False))


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text has one language with at least ``least`` of its n-grams; all columns.

    Rows without a letter go, null and empty texts among them; rows without an id are judged like others but not learned
    from, repeated rows stay repeated, columns keep their values whatever their names. The rows are written here, so that
    long texts pass to Python in batches bounded in bytes."""
    with small_batches(docs.sparkSession):
        names, model = train(docs, learned_from())
        found = detect(docs.select(F.struct(*docs.columns).alias("_row"), "text"), names, model, ["_row"])
        return materialize(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*"))
