"""Document fingerprints: quartile digests of hashed byte triplets, and edits against the next document."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.llm.tables import pa_schema, per_row

BUCKETS = 256
#: Places of the bytes of each triplet inside a sliding window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 5), (0, 2, 6), (0, 4, 7))
#: Difference of two bucket codes; opposite ends weigh more than their distance.
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
#: Bucket difference of unrelated texts, about: their codes are independent. Larger differences count as this one.
UNRELATED = int(STEP.mean() * BUCKETS)
LENGTH_STEP = 12


def digest(text: str | None) -> str:
    """Hex digest: length class (2 digits), two quartile ratios (1 digit each), then two bits per bucket."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    n, counts = len(raw), np.zeros(BUCKETS, np.int64)
    for salt, (i, j, k) in enumerate(TRIPLETS):
        if n > k:
            m = n - k
            h = raw[i:i + m] * np.uint32(2654435761) + raw[j:j + m] * np.uint32(2246822519) + raw[k:k + m] * np.uint32(3266489917) + np.uint32(salt * 668265263 % (1 << 32))
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    head = min(255, round(8 * math.log2(n + 1)))
    ratio = (lambda q: q * 15 // q3) if q3 else (lambda q: 0)
    return f"{head:02x}{ratio(q1):x}{ratio(q2):x}{body.astype(np.uint8).tobytes().hex()}"


def _codes(value: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(value[4:]), np.uint8)
    return np.stack((body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3), axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests down to 0 at a difference that unrelated texts have."""
    if a == b:
        return 1.0
    body = int(STEP[_codes(a), _codes(b)].sum())
    head = min(LENGTH_STEP, abs(int(a[:2], 16) - int(b[:2], 16))) + abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16))
    return 1.0 - min(body + head, UNRELATED) / UNRELATED


def edit(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``other``, or all that it has."""
    cut = len(text) // 3
    return text[:len(text) - cut] + other[:cut]


def compare(text: str, own: str, other: str, others: str) -> tuple[str, str, float, float]:
    edited = edit(text, other)
    made = digest(edited)
    return hashlib.sha256(edited.encode()).hexdigest(), made, likeness(own, made), likeness(own, others)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text, and the likeness to that and to the next.

    The next document follows in descending doc_id (then text hash; null ids last); after the last comes the first, which
    in a table of one row is itself. Documents are range-partitioned by that order; each task streams through its
    sorted rows and keeps one row behind. What crosses a border is the first and last row of each partition: they are
    written beside the results and meet in a join on the partition. Null texts count as empty; very long texts are taken
    whole; repeated rows follow each other, ties in doc_id go by text hash; other columns are ignored; an empty table gives an empty table.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key"))
    schema = f"{RESULT}, part int, side int, text string"
    fields = pa_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, last = TaskContext.get().partitionId(), None

        def border(row: tuple, side: int) -> tuple:
            doc_id, text, own = row
            return (doc_id, len(text), None, own, None, None, None, part, side, text)
        out: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                row = (doc_id, text, digest(text))
                if last is None:
                    out.append(border(row, 0))
                else:
                    sha, made, near, far = compare(last[1], last[2], text, row[2])
                    out.append((last[0], len(last[1]), sha, last[2], made, near, far, part, None, None))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields) if out else pa.RecordBatch.from_pylist([], schema=fields)
            out = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(border(last, 1), strict=True), fields, strict=True)], schema=fields)

    made = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, schema))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ends = made.filter("side IS NOT NULL").select("doc_id", "part", "side", "text", "fingerprint")
    heads = ends.filter("side = 0").select(F.col("part").alias("_next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    by_part, everything = Window.partitionBy(F.lit(0)).orderBy("part"), Window.partitionBy(F.lit(0))
    # Numbers of the parts alone are put in order in one place; the texts meet on them in a join.
    chain = made.filter("side = 0").select("part").withColumn("_next", F.coalesce(F.lead("part").over(by_part), F.min("part").over(everything)))
    following = ends.filter("side = 1").join(chain, "part").join(heads, "_next")
    joined = per_row(following, "doc_id text fingerprint next_text next_print", RESULT,
                     lambda i, t, own, nt, nf: (i, len(t), *(lambda c: (c[0], own, c[1], c[2], c[3]))(compare(t, own, nt, nf))))
    return made.filter("side IS NULL").select(*names).unionByName(joined)
