"""Media columns: 8-bit audio in content-defined chunks, stored once per chunk, read back and verified."""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize, scratch_path, shuffles_dropped
from voltgrid.llm.tables import pa_schema

UNIT = 192
RATE = 8000
#: Bytes of a chunk: at least, about and at most. The last of a payload may be shorter.
LEAST, MOST, CUT_BITS = 1024, 16384, 12
#: One pseudo-random 32-bit number per byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4]) for b in range(256)], np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def wave(samples: int) -> bytes:
    """Header of a mono file of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples)


def read_wave(media: bytes) -> np.ndarray:
    riff, _, kind, fmt, _, code, channels, _, _, _, bits, tag, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, kind, fmt, tag, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != 44 + n:
        raise ValueError("not a mono file of 8-bit samples")
    return np.frombuffer(media, np.uint8, offset=44)


def chunks(data: bytes) -> list[int]:
    """Chunk lengths. A cut falls where the gear hash of the last 32 bytes has its highest ``CUT_BITS`` bits at zero.

    The rolling hash adds the gear number of each byte, doubled once per byte since; it is summed here by doubling spans.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    while at < n:
        k = int(np.searchsorted(cuts, at + LEAST))
        end = min(n, at + MOST, int(cuts[k]) if k < len(cuts) else n)
        out.append(end - at)
        at = end
    return out


def name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def pieces(data: bytes, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[b - n:b] for b, n in zip(ends, sizes, strict=True)]


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, sign changes and byte entropy of the decoded samples."""
    x = samples.astype(np.float64) - 128
    p = np.bincount(samples, minlength=256) / len(samples)
    p = p[p > 0]
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};turns={int((np.diff(np.sign(x - x.mean())) != 0).sum())};entropy={-(p * np.log2(p)).sum():.4f}"


def _map(df: DataFrame, schema: str, fn) -> DataFrame:
    """Rows of Arrow batches through ``fn``, one row each, read column by column in order."""
    fields = pa_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(*r) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def listing(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, names, sizes): the ordered chunk list of every document; payload is the hash of its bytes."""
    def fn(doc_id: int | None, text: str | None) -> tuple:
        n, data = payload(text)
        sizes = chunks(data)
        return doc_id, n, hashlib.sha256(data).digest(), [name(c) for c in pieces(data, sizes)], sizes
    return _map(docs.select("doc_id", "text"), "doc_id long, n_bytes long, payload binary, names array<binary>, sizes array<int>", fn)


def store(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The chunk store, one row per distinct payload: its header, its chunk list and the bytes of the chunks it owns.

    Joins on chunk names find the chunks that several payloads share; the first payload owns such a chunk and ``lent``
    marks it there, the others keep its name only. Only hashes and compressed bytes travel, and copies of a payload
    meet before the shuffle. ``whole`` payloads own all their chunks.
    """
    recipes = listed.groupBy("payload").agg(F.first(F.struct("names", "sizes")).alias("r")).select("payload", "r.*")
    uses = recipes.select("payload", F.posexplode("names").alias("i", "name"))
    shared = uses.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("payload", "i")).alias("owner")).filter("n > 1")
    marks = uses.join(shared, "name").select("payload", F.struct("i", ((F.col("owner.payload") == F.col("payload")) & (F.col("owner.i") == F.col("i"))).alias("own")).alias("mark"))
    marked = materialize(recipes.join(marks.groupBy("payload").agg(F.collect_list("mark").alias("marks")), "payload", "left"))

    def shrink(text: str | None) -> tuple:
        data = payload(text)[1]
        return hashlib.sha256(data).digest(), [bz2.compress(c) for c in pieces(data, chunks(data))]

    def keep(key: bytes, parts: list[bytes], names: list[bytes], sizes: list[int], marks: list[dict] | None) -> tuple:
        own = {m["i"]: m["own"] for m in marks or []}
        kept = [c if own.get(i, True) else None for i, c in enumerate(parts)]
        return key, wave(sum(sizes)), names, kept, sorted(i for i, mine in own.items() if mine), all(own.values())

    blobs = _map(docs.select("text"), "payload binary, parts array<binary>", shrink).groupBy("payload").agg(F.first("parts").alias("parts"))
    rows = _map(blobs.join(marked, "payload").select("payload", "parts", "names", "sizes", "marks"),
                "payload binary, header binary, names array<binary>, chunks array<binary>, lent array<int>, whole boolean", keep)
    path = scratch_path(docs.sparkSession, "chunks")
    with shuffles_dropped(docs.sparkSession):
        rows.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


READ = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(chunk_store: DataFrame) -> DataFrame:
    """Every media file put together from its chunk list, verified chunk by chunk and as a whole, and its features.

    Payloads that own all chunks are read where they lie. For the others, missing names join the lent chunks.
    """
    def rebuild(key: bytes, header: bytes, names: list[bytes], kept: list[bytes | None], lent: list[dict] | None) -> tuple:
        found = {x["i"]: x["chunk"] for x in lent or []}
        parts = [bz2.decompress(c if c is not None else found[i]) for i, c in enumerate(kept)]
        if [name(p) for p in parts] != names:
            raise ValueError("a chunk does not match its name")
        media = header + b"".join(parts)
        samples = read_wave(media)
        data = samples.tobytes()
        if hashlib.sha256(data).digest() != key:
            raise ValueError("a payload does not match its hash")
        return key, len(data), key.hex(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    def media(df: DataFrame, lent) -> DataFrame:
        return _map(df.select("payload", "header", "names", "chunks", lent), READ, rebuild)

    none = F.lit(None).cast("array<struct<i: int, chunk: binary>>").alias("found")
    parted = chunk_store.filter("NOT whole")
    missing = parted.select("payload", F.posexplode(F.arrays_zip("names", "chunks")).alias("i", "c")).filter("c.chunks IS NULL").select("payload", "i", F.col("c.names").alias("name"))
    offered = chunk_store.filter(F.size("lent") > 0).select(F.explode("lent").alias("k"), "names", "chunks").select(F.expr("names[k]").alias("name"), F.expr("chunks[k]").alias("chunk"))
    found = missing.join(offered, "name").groupBy("payload").agg(F.collect_list(F.struct("i", "chunk")).alias("found"))
    return media(chunk_store.filter("whole"), none).unionByName(media(parted.join(found, "payload", "left"), F.col("found")))


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every document.

    The UTF-8 text, padded by blanks to a positive multiple of ``UNIT`` bytes, becomes the samples of a mono 8-bit file
    that is stored in content-defined chunks and read back. Null texts count as empty; equal texts share one stored
    file; repeated rows come back repeated; other columns are ignored; an empty table gives an empty table.
    """
    listed = materialize(listing(docs))
    files = materialize(read_back(store(docs, listed)))
    return listed.select("doc_id", "n_bytes", "payload").join(files, "payload").drop("payload")
