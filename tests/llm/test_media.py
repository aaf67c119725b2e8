import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import media


def check(df):
    out = media.media_columns(df).collect()
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in df.collect()), key=repr)
    assert len(out) == len(texts)
    want = []
    for i, raw in texts:
        padded = raw + b" " * (-len(raw) % 192) or b" " * 192
        whole = media.wave(len(padded)) + padded
        want.append((repr(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(whole), hashlib.sha256(whole).hexdigest(), media.feature(media.read_wave(whole))))
    assert sorted((repr(r.doc_id), *list(r)[1:]) for r in out) == sorted(want)


def test_awkward_rows(spark):
    check(awkward(spark))
    assert media.media_columns(empty(spark)).count() == 0


def test_shared_chunks_are_stored_once(spark):
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    rows = [row(i, f"{i} own start " * 40 + body + f" own end {i}") for i in range(6)] + [row(10 + i, body) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    listed = media.materialize(media.listing(df))
    kept = media.store(df, listed).collect()
    names = [n for r in kept for n, c in zip(r.names, r.chunks, strict=True) if c is not None]
    assert len(names) == len(set(names)) and set(names) == {n for r in kept for n in r.names}
    assert len(kept) == 7 and sum(len(r.names) for r in kept) > 2 * len(names)
    check(df)


def test_cuts_follow_the_content():
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(100_000))
    sizes = media.chunks(data)
    assert sum(sizes) == len(data) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    moved = media.pieces(b"x" * 777 + data, media.chunks(b"x" * 777 + data))
    assert len({*moved} & {*media.pieces(data, sizes)}) > 0.7 * len(sizes)
    at = 40_000  # the hash by doubling spans is the rolling one
    h = 0
    for b in data[at - 31:at + 1]:
        h = (2 * h + int(media.GEAR[b])) % (1 << 32)
    part = data[:at + 1]
    g = media.GEAR[list(part)]
    assert h == sum(int(g[-1 - k]) << k for k in range(32)) % (1 << 32)


def test_a_damaged_file_is_refused():
    with pytest.raises(ValueError, match="8-bit"):
        media.read_wave(media.wave(4) + b"abc")
