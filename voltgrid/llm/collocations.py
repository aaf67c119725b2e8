"""Phrases that stand together more often than their parts: n-grams counted losslessly in counting quotient filters."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

LONGEST, FLOOR, TOP = 4, 30, 2000
#: A phrase goes where a longer one has this share of its occurrences, in hundredths.
COVERED = 80
UNKNOWN = "und"
#: n-grams that a filter or a merge holds, about; prefix bits that one merge adds to the address of a filter.
ENTRIES, FAN = 2_000_000, 10
#: Bits of the table that says which phrases may be frequent: 8 MB whatever the corpus.
TABLE_BITS = 26
#: Bytes of a text that are split at once, about; words that are counted or remembered at once, about.
BLOCK, WORDS = 4_000_000, 300_000
SALTS = 16
MARK = b"\xff"  # no byte of UTF-8
#: Lower-cases A-Z, and marks the ends of pieces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
ODD, C1, C2 = np.uint64(0x9E3779B97F4A7C15), 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53  # odd constants of published 64-bit mixers
ENCODED = "slot long, q int, size int, buckets binary, counts binary, remainders binary"


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text with MARK between pieces; long texts in runs that end where a piece ends."""
    raw, at = (text or "").encode().translate(PLAIN), 0
    while at < len(raw):
        cut = raw.find(MARK, at + BLOCK) if len(raw) - at > BLOCK else -1
        end = len(raw) if cut < 0 else cut
        yield raw[at:end].replace(MARK, b" \xff ").split()
        at = end + 1


class WordIds(dict):
    """64-bit ids of a language's words; 0 is the mark between pieces."""

    def __init__(self, lang: str, salt: int, bits: int) -> None:
        self.seed, self.mask = xxhash.xxh64_intdigest(lang, salt), (1 << bits) - 1
        self[MARK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, self.seed) & self.mask or 1
        return found


def vocabulary(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of all words, written, and the salt of the ids.

    Ids are hashes. That no two words share one is checked over the whole vocabulary; if two do, another salt is taken,
    so that ids stand for words without loss.
    """
    def counted(salt: int) -> DataFrame:
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("n", pa.int64())])

        def emit(counts: dict[str, Counter]) -> pa.RecordBatch:
            rows = [(lang, w.decode(), i - (1 << 64) if i >> 63 else i, n) for lang, c in counts.items() for ids in [WordIds(lang, salt, bits)] for w, n in c.items() if (i := ids[w])]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[str, Counter] = defaultdict(Counter)
            for b in batches:
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for words in word_runs(text):
                        counts[lang].update(words)
                    if len(counts[lang]) > WORDS:
                        yield emit({lang: counts.pop(lang)})
                if sum(map(len, counts.values())) > WORDS:
                    yield emit(counts)
                    counts.clear()
            yield emit(counts)

        return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))

    salt = 0
    while True:
        words = materialize(counted(salt))
        if not words.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count():
            return words, salt
        salt += 1


def _mix(x: np.ndarray) -> np.ndarray:
    for c in (C1, C2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


def _unmix(x: np.ndarray) -> np.ndarray:
    for c in (C2, C1):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(pow(c, -1, 1 << 64))
    return x ^ (x >> np.uint64(33))


def permute(words: np.ndarray) -> np.ndarray:
    """Packed n-grams (one line of 64-bit ids per word) under a permutation: the first line becomes uniform, the others stay."""
    x = words[0]
    for w in words[1:]:
        x = _mix(x ^ (w * ODD))
    return np.vstack([x[None], words[1:]])


def unpermute(lanes: np.ndarray) -> np.ndarray:
    x = lanes[0]
    for w in lanes[:0:-1]:
        x = _unmix(x) ^ (w * ODD)
    return np.vstack([x[None], lanes[1:]])


def combine(lanes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    def alike(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = lanes[:, order]
        first = s[0, 1:] == s[0, :-1]
        return s, n[order], first, first & (s[1:, 1:] == s[1:, :-1]).all(axis=0)

    if not len(n):
        return lanes, n
    s, m, first, same = alike(np.argsort(lanes[0]))
    if (first & ~same).any():
        s, m, first, same = alike(np.lexsort(lanes[::-1]))
    at = np.flatnonzero(np.concatenate(([True], ~same)))
    return s[:, at], np.add.reduceat(m, at)


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(64 - bits) if bits else np.zeros_like(x)


def _short(values: np.ndarray) -> bytes:
    """Counters of one byte each; those of 255 and more follow with eight."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def _unshort(raw: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=size)
    return out


def encode(lanes: np.ndarray, n: np.ndarray, prefix: int) -> Iterator[tuple]:
    """Filters of sorted keys, one for each value of their first ``prefix`` bits.

    A filter of m keys has about m buckets. The quotient, the leading bits of a key, names the bucket and is kept as
    bucket sizes only; the rest of the key is kept in full, so that nothing is lost and equal keys alone share a counter.
    """
    slots, starts = np.unique(_top(lanes[0], prefix), return_index=True)
    for slot, a, b in zip(slots.tolist(), starts.tolist(), [*starts[1:].tolist(), lanes.shape[1]], strict=False):  # no key, no slot
        q = min(56, prefix + (b - a - 1).bit_length())
        bucket = (_top(lanes[0, a:b], q) - np.uint64(slot << (q - prefix))).astype(np.int64)
        sizes = np.bincount(bucket, minlength=1 << (q - prefix))
        rest = np.ascontiguousarray(lanes[0, a:b]).view(np.uint8).reshape(-1, 8)[:, :(71 - q) // 8]
        yield slot, q, b - a, _short(sizes), _short(n[a:b]), rest.tobytes() + np.ascontiguousarray(lanes[1:, a:b]).tobytes()


def decode(slot: int, q: int, size: int, buckets: bytes, counts: bytes, remainders: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = _unshort(buckets, 1 << (q - prefix))
    quotient = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) + np.uint64(slot << (q - prefix))
    width = (71 - q) // 8
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :width] = np.frombuffer(remainders, np.uint8, size * width).reshape(size, width)
    low = wide.view(np.uint64).ravel()
    first = low if not q else (quotient << np.uint64(64 - q)) | (low & np.uint64((1 << (64 - q)) - 1))
    return np.vstack([first[None], np.frombuffer(remainders, np.uint64, offset=size * width).reshape(-1, size)]), _unshort(counts, size)


def table_of(found: DataFrame) -> np.ndarray:
    """A table of 2^TABLE_BITS bits, one set for each hash ``h`` of ``found``. The driver gets a million numbers at most."""
    at = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    rows = found.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def _may(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _top(h, TABLE_BITS)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def grams(words: np.ndarray, k: int, table: np.ndarray) -> np.ndarray:
    """Permuted k-grams inside pieces, without those of which a part one word shorter can't be frequent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty((k, 0), np.uint64)
    part = _may(table, permute(np.stack([words[j:j + n + 1] for j in range(k - 1)]))[0])
    inside = part[:-1] & part[1:]
    for j in range(k):
        inside &= words[j:j + n] != 0
    at = np.flatnonzero(inside)
    return permute(np.stack([words[at + j] for j in range(k)]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (("slot", pa.int64()), ("q", pa.int32()), ("size", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary()), ("remainders", pa.binary()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[x for x, _ in types])


def filters(docs: DataFrame, k: int, table: np.ndarray, salt: int, bits: int, prefix: int, entries: int) -> DataFrame:
    """Counting quotient filters of the k-grams of each task: some hold a part of a task each, none much more than ``entries`` n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, WordIds] = {}
        held: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            lanes = np.hstack(held)
            held.clear()
            return _rows(list(encode(*combine(lanes, np.ones(lanes.shape[1], np.int64)), prefix)))

        def numbers() -> Iterator[np.ndarray]:
            for b in batches:
                block: list[np.ndarray] = []
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    known = ids.get(lang)
                    if known is None or len(known) > WORDS:
                        known = ids[lang] = WordIds(lang, salt, bits)
                    for words in word_runs(text):
                        words.append(MARK)
                        block.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                    if len(block) >= 256:
                        yield np.concatenate(block)
                        block = []
                if block:
                    yield np.concatenate(block)

        for words in numbers():
            held.append(grams(words, k, table))
            if sum(x.shape[1] for x in held) >= entries:
                yield full()
        if held:
            yield full()

    return docs.mapInArrow(run, ENCODED)


def merged(shards: DataFrame, prefix: int, to: int | None, floor: int = 1) -> DataFrame:
    """Filters of one slot (and part) merged: into filters of longer prefixes, or without ``to`` into (ids, h, n) of n >= ``floor``."""
    def fn(key: tuple, rows: pa.Table) -> pa.Table:
        columns = [rows[c].to_pylist() for c in ("slot", "q", "size", "buckets", "counts", "remainders")]
        parts = [decode(*r, prefix) for r in zip(*columns, strict=True)]
        lanes, n = combine(np.hstack([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
        if to is not None:
            return pa.Table.from_batches([_rows(list(encode(lanes, n, to)))])
        lanes, n = lanes[:, n >= floor], n[n >= floor]
        ids = np.ascontiguousarray(unpermute(lanes).T).view(np.int64).ravel()
        edges = pa.array(np.arange(len(n) + 1, dtype=np.int32) * lanes.shape[0])
        return pa.table({"ids": pa.ListArray.from_arrays(edges, pa.array(ids)), "h": pa.array(np.ascontiguousarray(lanes[0]).view(np.int64)), "n": pa.array(n)})

    return shards.groupBy("slot", "_part").applyInArrow(fn, ENCODED if to is not None else "ids array<long>, h long, n long")


def frequent(docs: DataFrame, k: int, shorter: DataFrame, total: int, salt: int, floor: int, bits: int = 64, entries: int = ENTRIES, fan: int = FAN) -> DataFrame:
    """(ids, h, n) of all k-grams with n >= ``floor``, where ``shorter`` has the frequent ones of k - 1 words.

    Tasks build filters; filters of one slot, the leading bits of permuted keys, are merged. Keys are uniform and a filter
    holds a key once, so slots are alike however common a phrase is, and their number grows with the corpus. A task
    names at most 2^``fan`` slots; beyond that, merges run in rounds, each over parts of a slot of bounded size.
    """
    need = max(0, math.ceil(math.log2(max(1, total) / entries)))
    prefix = min(need, fan)
    shards = filters(docs, k, table_of(shorter), salt, bits, prefix, entries)
    while prefix < need:
        to = min(need, prefix + fan)
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << (need - prefix)))
        shards, prefix = merged(shards.withColumn("_part", part), prefix, to), to
    return materialize(merged(shards.withColumn("_part", F.lit(0).cast("long")), prefix, None, floor))


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _looked_up(rows: DataFrame, known: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
    """Columns of ``known`` for the phrase ``by``. Parts such as an article are very common, so ``known`` is repeated over salts."""
    salts = known.select(F.col("ids").alias(by), *[F.col(a).alias(b) for a, b in names.items()], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).join(salts, [by, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, longest: int = LONGEST, floor: int = FLOOR, top: int = TOP, covered: int = COVERED, bits: int = 64, entries: int = ENTRIES, fan: int = FAN) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into words at blanks and tabs. A phrase
    of 2 to ``longest`` words with a >= ``floor`` occurrences is cut where 2000000 a / (l + r), rounded down, is smallest
    (l, r: occurrences of the two parts; ties to the shorter first part). It goes if its words lie inside a longer phrase
    with at least ``covered`` hundredths of its occurrences. Counts are exact at any size, and so is the arithmetic.

    Words are counted first; then phrases of two words, three and so on, each level leaving out phrases with a part that
    can't be frequent by a table of fixed size, whose false alarms cost work but no result. Nothing of the corpus goes
    through the driver or to all tasks but that table. A null or empty text has no words, a null lang is ``und``, a
    very long text is read in runs of pieces, repeated rows count each for itself, ties go by count and then by the bytes
    of the phrase. An empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter("text IS NOT NULL")
    words, salt = vocabulary(rows, bits)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = words.filter(F.col("n") >= floor)
    levels = [common.select(F.array("id").alias("ids"), F.col("id").alias("h"), "n")]
    for k in range(2, longest + 1):
        levels.append(frequent(rows, k, levels[-1], total, salt, floor, bits, entries, fan))
    known = common.select(F.array("id").alias("ids"), "n", "lang")
    for level in levels[1:]:
        known = known.unionByName(level.select("ids", "n"), allowMissingColumns=True)
    phrases = known.filter("size(ids) > 1").select("ids", F.col("n").alias("a"))

    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    parts = phrases.withColumn("cut", cut).withColumn("left", F.expr("slice(ids, 1, cut)")).withColumn("right", F.expr("slice(ids, cut + 1, size(ids) - cut)"))
    sides = _looked_up(_looked_up(parts, known, "left", {"n": "l", "lang": "lang"}), known, "right", {"n": "r"})
    score = F.call_function("div", _wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), _wide("l") + _wide("r"))
    scored = sides.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.max("lang").alias("lang"))

    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    inside = phrases.filter("size(ids) > 2").select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    free = scored.join(inside, "ids", "left").filter(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * covered))

    best = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc())
    first = materialize(free.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= top).drop("_r"))
    spelled = first.select("ids", F.posexplode("ids").alias("pos", "id")).join(common.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = first.join(spelled, "ids").select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
