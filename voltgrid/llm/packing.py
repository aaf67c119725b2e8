"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrid.functions.durable import scratch_path, shuffles_dropped

LENGTH = 2048
END = 1
#: Remainders that one group packs, about; each has less than LENGTH tokens, so a group has 32 MB of ids at most, about.
GROUP = 4096
#: Bytes of words and ids that a worker remembers, about, in each of two generations; of these, what a word costs by itself.
REMEMBERED, PER_WORD = 48 << 20, 200
#: Bytes of a row group of written ids: what a task holds while it writes or reads them.
ROW_GROUP = 16 << 20
#: Sequences that one piece fills are numbered from here.
FULL = 1 << 62


class Merges:
    """Byte-pair merges of many words at once: in each round every word takes its pair of lowest rank, wherever it stands.

    Only for words that the vocabulary's pre-tokenizer leaves whole and its normalizer unchanged.
    """

    BITS = 20
    NONE = np.int64(1 << 40)

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        names = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner, self.last = (np.array([vocab.get(names[b] + e, -1) for b in range(256)], np.int64) for e in ("", end))
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        slots, first = np.unique(self._slot(keys), return_index=True)
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE)
        self.keys[slots], self.ranks[slots] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)  # pairs whose slot another pair holds
        order = np.argsort(keys[rest])
        self.more_keys, self.more_ranks = keys[rest][order], rest[order]
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[self._slot(self.more_keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        again = np.flatnonzero(self.shared[at] & (found == self.NONE))
        if len(again):
            k = np.minimum(np.searchsorted(self.more_keys, keys[again]), len(self.more_keys) - 1)
            found[again] = np.where(self.more_keys[k] == keys[again], self.more_ranks[k], self.NONE)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian unsigned 32-bit."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes) - 1
        ids, word = self.inner[flat], np.repeat(np.arange(len(words)), sizes)
        ids[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            rank = np.full(len(ids), self.NONE)
            pair = np.flatnonzero(word[1:] == word[:-1])
            rank[pair] = self.rank(ids[pair] << 20 | ids[pair + 1])
            best = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(best, np.diff(np.append(starts, len(ids))))
            over = lowest == self.NONE
            if over.any():
                done.append((word[over], ids[over]))
            hit = np.flatnonzero((rank == lowest) & ~over)
            if len(hit):  # of hits in a row, as in "aaa", every second one
                run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
                ids[hit] = self.made[rank[hit]]
                over[hit + 1] = True
            ids, word = ids[~over], word[~over]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        raw, edges = ids[order].astype("<u4").tobytes(), (4 * np.append(np.flatnonzero(np.diff(word[order], prepend=-1)), len(ids))).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    The vocabulary's pre-tokenizer drops white space and never joins characters across it, nor letters with anything else,
    and a token that ends such a piece is marked in the vocabulary. So a text's ids are the ids of its words one after
    another, and each distinct word is encoded once: words of Latin letters by merging many at a time, words of other
    letters together in one line that is cut at the marks, with trailing punctuation by itself. Two generations of words are remembered, bounded in bytes.
    """

    TAIL = b",.;:!?"
    #: Bytes of words of lower-case Latin letters, which stay as they are: a-z, and the two bytes of those from U+00DF on.
    LETTERS = bytes([*range(97, 123), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
    #: A word in a line of its own: letters and punctuation behind them, or anything else.
    KINDS = re.compile(rb"^(?:([" + LETTERS + rb"]+)([" + TAIL + rb"]*)|([^\n]+))$", re.MULTILINE)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.older, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _line(self, words: list[bytes]) -> None:
        """Words of letters alone, encoded as one line and cut where tokens end a word."""
        if not words:
            return
        line = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * np.flatnonzero(self.ends[line]) + 4).tolist()
        if len(stops) == len(words):
            raw = line.tobytes()
            self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        else:  # a letter fell apart on the way to lower case
            self._each(words)

    def _each(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _encode(self, words: set[bytes]) -> None:
        found = self.KINDS.findall(b"\n".join(words))
        bare, tailed = [c for c, t, _ in found if c and not t], [(c, t) for c, t, _ in found if t]
        plain, other, odd = {*bare, *(c for c, _ in tailed)}, [], []
        for w in (w for _, _, w in found if w):
            core = w.rstrip(self.TAIL)
            if core and core.decode().isalpha():
                other.append(core)
                if len(core) < len(w):
                    tailed.append((core, w[len(core):]))
            else:
                odd.append(w)
        plain, other = (list(set(x).difference(self.known)) for x in (plain, other))
        made = dict(zip(plain, self.merges.encode(plain), strict=True))
        self._line(other)
        self._each(list({*odd, *(t for _, t in tailed)}.difference(self.known)))
        known = self.known
        known.update([(c + t, (made.get(c) or known[c]) + known[t]) for c, t in tailed])
        known.update(zip(bare, map(made.__getitem__, bare), strict=True))  # words met with a tail only are not kept without it

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # lower-cases A-Z only
        lines = pc.ascii_split_whitespace(texts)  # also gives empty words, at the ends of a text
        coded = lines.flatten().dictionary_encode()
        words, index = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.size > REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        self.known[b""] = b""
        missing = set(words).difference(self.known)
        if missing:
            if self.older:
                self.known.update([(w, self.older[w]) for w in missing if w in self.older])
            if new := missing.difference(self.known):
                self._encode(new)
            self.size += sum(map(len, missing)) * 2 + PER_WORD * len(missing)
        raw = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, starts, taken = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes, sizes[index]
        upto = np.append(0, np.cumsum(taken))
        ids = flat[np.repeat(starts[index] - upto[:-1], taken) + np.arange(upto[-1])].tobytes()
        edges = (4 * upto[lines.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


#: One per tokenizer and worker process: tasks that follow each other share what they remember.
_HELD: dict[str, WordIds] = {}


def held(path: str) -> WordIds:
    if path not in _HELD:
        _HELD[path] = WordIds(path)
    return _HELD[path]


def turned(raw: bytes, width: int) -> bytes:
    """Bytes written in rows of ``width``, read by columns."""
    return np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()


#: Bytes of texts whose words are looked up together, about: some 500 usual texts, and long ones by themselves.
TOGETHER = 2 << 20


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, planes: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text): their token ids and ``end``, cut into runs of ``length`` and a remainder.

    A null or empty text is the end token alone. Key is a hash of the text, ids little-endian unsigned 32-bit numbers.
    Every row of ``docs`` gives its own pieces, repeated rows too. With ``planes`` the first bytes of all ids of a piece
    come first, then the second ones and so on: high bytes are mostly 0 and take hardly any room once compressed.
    """
    last = np.array([end], "<u4").tobytes()
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "key", "start", "length", "doc_tokens")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(tokenizer)
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = np.flatnonzero(np.diff(upto // TOGETHER, prepend=-1)).tolist()
            for at, stop in zip(starts, [*starts[1:], b.num_rows], strict=False):
                out = []
                some = b.slice(at, stop - at)
                encoded = words.encode(some.column("text"))
                for doc_id, key, ids in zip(some.column("doc_id").to_pylist(), some.column("key").to_pylist(), encoded, strict=True):
                    ids += last
                    for start in range(0, len(ids), 4 * length):
                        part = ids[start:start + 4 * length]
                        out.append((doc_id, key, start // 4, len(part) // 4, len(ids) // 4, turned(part, 4) if planes else part))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        words.older = {}

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, start long, length long, doc_tokens long, ids binary")


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken longest first, each into the first bin with room.

    A tournament tree over the bins holds at each node the largest room below it, so that the first bin with room is
    found, and its path to the root mended, in log(bins) steps.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [size] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, size - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


PARTS = ("doc_id", "key", "start", "length", "doc_tokens", "offset")


def pack(parts: DataFrame, length: int = LENGTH, seed: int = 4, group: int = GROUP) -> DataFrame:
    """(sequence_id, tokens, ids, parts) of pieces: first-fit decreasing inside random groups of about ``group`` pieces.

    Groups are drawn row by row, so that no source, length or repeated document fills one, and are of bounded size at any
    input. Group g numbers its sequences g * 2^32, g * 2^32 + 1, ... Every row of ``parts`` has its own place, also where
    documents are repeated; pieces of equal length are taken in order of doc_id, key and start. The ids of ``parts`` are
    in planes. Parts name the pieces of a sequence in order of offset. An empty table gives an empty table.
    """
    groups = max(1, math.ceil(parts.count() / group))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    named = pa.struct([(n, pa.int64()) for n in PARTS])
    schema = pa.schema([("sequence_id", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary()), ("parts", pa.list_(named))])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        _HELD.clear()  # texts are encoded by now: room for ids
        names = [n for n in PARTS if n != "offset"]
        by_row = pc.sort_indices(rows.select(names), [("doc_id", "ascending"), ("key", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(rows["length"].take(by_row).to_numpy(), length)
        order = np.lexsort((offsets, bins))
        place = by_row.take(pa.array(order))
        bins, offsets, ids, rows = bins[order], offsets[order], rows["ids"], rows.select(names).take(place)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        edges = np.append(first, len(bins)).astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(rows["length"].to_numpy())))[edges]
        data = pa.py_buffer(b"".join(turned(v.as_py(), v.as_buffer().size // 4) for v in ids.take(place)))
        columns = [pa.array(offsets) if n == "offset" else pa.concat_arrays(rows[n].chunks).cast(pa.int64()) for n in PARTS]
        return pa.Table.from_arrays([
            pa.array((key[0].as_py() << 32) + bins[first]), pa.array(np.diff(ends)),
            pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * ends).astype(np.int32)), data]),
            pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(columns, fields=list(named)))], schema=schema)

    struct = ", ".join(f"{n}: long" for n in PARTS)
    return dealt.groupBy("_group").applyInArrow(fit, f"sequence_id long, tokens long, ids binary, parts array<struct<{struct}>>")


@contextmanager
def two_writers(spark: SparkSession) -> Iterator[None]:
    """Tasks that write two folders keep two files open instead of sorting wide rows."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(df: DataFrame, *by: str) -> DataFrame:
    """Write rows with ids and read them back: beside the checkpoints, in small row groups."""
    path = scratch_path(df.sparkSession, "ids")
    with shuffles_dropped(df.sparkSession), two_writers(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unturned(full: DataFrame, ids: bool) -> DataFrame:
    """Full pieces with their ids in order of place (if ``ids``) and the digest of these, from written planes."""
    named = [f for f in full.schema if f.name != "ids"]
    kept = [f.name for f in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [turned(v, len(v) // 4) for v in b.column("ids").to_pylist()]
            cols = [*(b.column(c) for c in kept), pa.array(map(zlib.crc32, plain), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(plain, pa.binary())] if ids else cols, names=[*kept, "ids_crc32", *["ids"] * ids])

    return full.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named) + ", ids_crc32 long" + ", ids binary" * ids)


def stored(docs: DataFrame, tokenizer: str, length: int = LENGTH, seed: int = 4) -> tuple[DataFrame, DataFrame]:
    """The written sequences: pieces that fill one each (with ids in planes), and remainders packed together.

    A piece of ``length`` tokens gets its sequence where it is cut and is written once; only remainders, fewer than
    documents, are shuffled into groups.
    """
    cut = pieces(docs, tokenizer, length, planes=True).withColumn("full", F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(FULL))
    table = _write(cut, "full")
    return table.filter("full").drop("full"), _write(pack(table.filter("NOT full").drop("full", "sequence_id"), length, seed))


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, seed: int = 4) -> DataFrame:
    """(sequence_id, tokens, ids, parts): the packed sequences; at most ``length`` ids each, not padded."""
    full, shared = stored(docs, tokenizer, length, seed)
    part = F.struct(*[F.lit(0).cast("long").alias(n) if n == "offset" else F.col(n) for n in PARTS])
    return _unturned(full, True).select("sequence_id", F.col("length").alias("tokens"), "ids", F.array(part).alias("parts")).unionByName(shared)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, seed: int = 4, ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` read from the written sequences: (doc_id, key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end token alone, a long one many full pieces and a remainder; repeated rows have places
    of their own, an empty table gives an empty table, and other columns are ignored. Without ``ids`` that column is left out.
    """
    full, shared = stored(docs, tokenizer, length, seed)

    def cut(p: Column) -> Column:
        some = F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
        return F.struct(*[p[n].alias(n) for n in PARTS], some.alias("ids"))

    names = ["doc_id", "key", "start", "length", *["ids"] * ids, "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parts = shared.select("sequence_id", F.explode(F.transform("parts", cut)).alias("p")).select("sequence_id", "p.*").withColumn("ids_crc32", F.crc32("ids"))
    return _unturned(full, ids).withColumn("offset", F.lit(0).cast("long")).select(*names).unionByName(parts.select(*names))
