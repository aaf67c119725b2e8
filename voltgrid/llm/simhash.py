"""Near-duplicate documents by 64-bit SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize, small_batches
from voltgrid.llm.tables import components, per_row

SEED = 42
PACK = 4096
#: Hashes whose bits are unpacked at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """Hashes of the word shingles of a whole text: fewer words give the whole sequence, no words give none."""
    words = (text or "").encode().lower().split()  # on bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    view, n = memoryview(line), len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that more than half of the hashes set, as bytes; 0 without hashes. ``hashes`` has a line of 64-bit numbers each.

    Bits are counted in blocks, of lines whose sum fits into a byte, so that rows of bits are added as they are.
    """
    lanes = hashes.shape[1] if hashes.ndim > 1 else 1
    lines = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8 * lanes)
    ones = np.zeros(8 * lines.shape[1], np.int64)
    for i in range(0, len(lines), BLOCK):
        bits = np.unpackbits(lines[i:i + BLOCK], axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(lines), bitorder="little")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of a whole text, as a signed 64-bit number; 0 for a text without words."""
    return int(majority(shingle_hashes(text, shingle)).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, key, fp) of every row of ``docs``; key is a hash of the text that tells rows with one doc_id apart."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return per_row(keyed, "doc_id key text", "doc_id long, key long, fp long", lambda i, k, t: (i, k, fingerprint(t, shingle)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int, bits: int) -> list[tuple[int, list[int]]]:
    """For each choice of ``blocks - bits`` blocks: its mask, and the masks of the earlier blocks that are not chosen.

    Two fingerprints that differ in at most ``bits`` bits agree in at least ``blocks - bits`` blocks. A pair belongs to its
    first agreeing choice only: there, every earlier block that is not chosen differs.
    """
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [(sum(block[i] for i in c), [block[i] for i in range(c[-1]) if i not in c]) for c in combinations(range(blocks), blocks - bits)]


def _forest(left: np.ndarray, right: np.ndarray | None, differ: list[int], bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
    if right is None and len(left) <= 12:
        values = left.tolist()
        for i, x in enumerate(values):
            for y in values[:i]:
                z = x ^ y
                if z.bit_count() <= bits and all(z & m for m in differ):
                    yield x, y
        return
    nodes = left if right is None else np.concatenate((left, right))
    side = np.zeros(len(nodes), bool)
    side[len(left):] = True
    apart = [np.uint64(m) for m in differ]
    fresh = np.ones(len(nodes), bool)
    for first in range(len(nodes)):
        if not fresh[first]:
            continue
        fresh[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            at = np.flatnonzero(fresh if right is None else fresh & (side != side[i]))
            z = nodes[at] ^ nodes[i]
            near = np.bitwise_count(z) <= bits
            for m in apart:
                near &= (z & m) != 0
            found = at[near]
            fresh[found] = False
            for k in found.tolist():
                yield int(nodes[i]), int(nodes[k])
            queue.extend(found.tolist())


def links(fps: DataFrame, bits: int = 4, blocks: int = 7) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``bits`` or fewer differing bits, as spanning forests.

    A fingerprint goes to one bucket per choice of blocks. Buckets are cut into packs of about ``PACK`` fingerprints; a
    kernel compares each pair of packs of a bucket and returns a spanning forest of its links, at most one row per
    fingerprint, never all pairs. The forests together connect exactly what all links connect. With seven blocks a
    bucket is named by about 27 bits; take eight (32 bits) beyond some 10^11 fingerprints. Rows per fingerprint and bucket are
    merged with their buckets, never broadcast: the planner takes them for as small as the fingerprints they come from.
    """
    choice = masks(blocks, bits)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("v")) for j, (m, _) in enumerate(choice)])).alias("k")).select("fp", "k.*")
    full = keyed.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    packs = (keyed.join(full.hint("merge"), ["j", "v"]).withColumn("packs", F.ceil(F.col("n") / PACK).cast("int"))
             .withColumn("p", F.pmod(F.xxhash64("fp"), F.col("packs")).cast("int"))
             .groupBy("j", "v", "packs", "p").agg(F.collect_list("fp").alias("fps")))
    alone = packs.filter("packs = 1").select("j", F.array("fps").alias("sides"))
    pairs = (packs.filter("packs > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
             .groupBy("j", "v", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi")).agg(F.collect_list("fps").alias("sides")).select("j", "sides"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for j, sides in zip(batch.column("j").to_pylist(), batch.column("sides"), strict=True):
                packs_here = [s.values.to_numpy().view(np.uint64) for s in sides]
                out.extend(_forest(packs_here[0], packs_here[1] if len(packs_here) > 1 else None, choice[j][1], bits))
            edges = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    return alone.unionByName(pairs).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, blocks: int = 7, shingle: int = 4) -> DataFrame:
    """(doc_id, key, fp, root, component_id) for every row of ``docs`` (doc_id, text).

    Root is the smallest fingerprint of the component and names it. Rows link when their fingerprints differ in at most ``bits`` bits; component_id is the smallest doc_id that can be
    reached, the row's own included. Null and empty texts have fingerprint 0 and link like any other;
    hashes of a very long text are counted in blocks. Repeated rows stay
    repeated rows of one component; a null doc_id is never the smallest unless the component has no other. An empty
    table gives an empty table; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), bits, blocks)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


#: Shingles and their least similarity (Jaccard) of near copies; 64-bit words of a long fingerprint.
WORDS, SIMILAR, LANES = 5, 0.8, 4
#: Share of pairs at the least similarity that the blocks bring together, and standard deviations of room for the Hamming test.
RECALL, ROOM = 0.95, 2.0
#: Rows, and bytes of shingles, of a pack of texts that are compared in full, about.
WHOLE, SHINGLES = 1024, 8 << 20
#: Blocks at least: small tables need few and can afford more. Blocks whose buckets are made at once.
BLOCKS, TOGETHER = 64, 24
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def long_fingerprint(text: str | None, shingle: int = WORDS, lanes: int = LANES) -> bytes:
    """SimHash of ``64 * lanes`` bits over the distinct shingles: each lane takes the hashes through a mixing of its own."""
    hashes = np.unique(shingle_hashes(text, shingle))
    m = _MULTIPLIERS[:lanes]
    x = (hashes ^ (hashes >> np.uint64(31)))[:, None] * m
    return majority((x ^ (x >> np.uint64(29))) * m).tobytes()


def differing(similarity: float) -> float:
    """Expected share of differing bits of two fingerprints: their angle over pi, the cosine from the Jaccard similarity of sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def farthest(bits: int, similarity: float) -> int:
    """Most differing bits of candidates: the expected number at ``similarity`` and ``ROOM`` standard deviations."""
    share = differing(similarity)
    return math.floor(bits * share + ROOM * math.sqrt(bits * share * (1 - share)))


def block_plan(count: int, similarity: float, recall: float, bits: int) -> list[np.ndarray]:
    """Bit positions of each block: wide enough, at any ``count``, that one in eight random fingerprints shares one at most,
    and so many that a pair at ``similarity`` shares one with probability ``recall``."""
    width = math.ceil(math.log2(max(1, count))) + 3
    number = max(BLOCKS, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** width)))
    rng = np.random.default_rng(SEED)
    return [rng.choice(bits, width, replace=False) for _ in range(number)]


def _least_forest(left: np.ndarray, right: np.ndarray | None, most: int) -> Iterator[tuple[int, int]]:
    """Pairs of row numbers: a spanning forest of least Hamming distances among links of at most ``most`` bits (Prim).

    Between ``left`` and ``right``, or inside ``left``. Inside up to eight rows, all links.
    """
    nodes = left if right is None else np.concatenate((left, right))
    n = len(nodes)
    if right is None and n <= 8:
        far = np.bitwise_count(nodes[:, None] ^ nodes[None]).sum(axis=2)
        yield from zip(*(x.tolist() for x in np.nonzero(np.triu(far <= most, 1))), strict=True)
        return
    side = np.arange(n) >= len(left)
    best, link, open_ = np.full(n, most + 1), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(open_, best, 1 << 30).argmin())
        if link[i] >= 0 and best[i] <= most:
            yield int(link[i]), i
        open_[i] = False
        far = np.bitwise_count(nodes ^ nodes[i]).sum(axis=1, dtype=np.int64)
        nearer = open_ & (far < best) if right is None else open_ & (far < best) & (side != side[i])
        best[nearer], link[nearer] = far[nearer], i


def candidate_links(prints: DataFrame, similarity: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between rows (key long, fp binary) that share a block and lie within the Hamming distance of ``similarity``.

    As for 64 bits, buckets are cut into packs that meet pairwise, and a kernel returns forests, one row per member at
    most. The forest is of least distances: most links of it stand a finer test. Where some don't, those that it leaves
    out matter (``linked_across``). Buckets are made for ``TOGETHER`` blocks at once, so that their rows, one per
    fingerprint and block, are never shuffled all together.
    """
    bits = 8 * len(prints.select("fp").head()[0]) if prints.head(1) else 64
    prints = prints.select("key", "fp")
    plan, most = block_plan(prints.count(), similarity, recall, bits), farthest(bits, similarity)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for sides in batch.column("sides"):
                members = [s.values for s in sides.values]
                keys = np.concatenate([m.field("key").to_numpy() for m in members]).tolist()
                lines = [np.frombuffer(b"".join(m.field("fp").to_pylist()), np.uint64).reshape(len(m), -1) for m in members]
                out.extend((keys[x], keys[y]) for x, y in _least_forest(lines[0], lines[1] if len(lines) > 1 else None, most))
            edges = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    def found(blocks_: list[np.ndarray]) -> Iterator[DataFrame]:
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                on = np.unpackbits(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
                for j, positions in enumerate(blocks_):
                    v = on[:, positions].astype(np.int64) @ (1 << np.arange(len(positions), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), b.column("key"), b.column("fp")], names=["j", "v", "key", "fp"])

        keyed = prints.mapInArrow(blocks, "j int, v long, key long, fp binary")
        full = materialize(keyed.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        member = F.collect_list(F.struct("key", "fp"))
        one = keyed.join(full.filter(F.col("n") <= PACK).hint("merge"), ["j", "v"]).groupBy("j", "v").agg(member.alias("one"))
        yield materialize(one.select(F.array("one").alias("sides")).mapInArrow(run, "a long, b long"))
        # A bucket per PACK rows at most: smaller than what they come from.
        large = materialize(full.filter(F.col("n") > PACK).select("j", "v", F.ceil(F.col("n") / PACK).cast("int").alias("packs")))
        if large.isEmpty():
            return
        packs = (keyed.join(large, ["j", "v"])
                 .withColumn("p", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int"))
                 .groupBy("j", "v", "packs", "p").agg(member.alias("one")))
        pairs = (packs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
                 .groupBy("j", "v", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi")).agg(F.collect_list("one").alias("sides")).select("sides"))
        yield materialize(pairs.mapInArrow(run, "a long, b long"))

    edges = [df for at in range(0, len(plan), TOGETHER) for df in found(plan[at:at + TOGETHER])]
    return reduce(DataFrame.unionByName, edges).distinct()


def _across(lines: np.ndarray, roots: np.ndarray, right: np.ndarray, between: bool, sets: list[np.ndarray], most: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of row numbers: a forest of the links that join rows of different roots.

    Rows link at ``most`` differing bits and at a similarity of their sorted ``sets``; the rows of a side, or those
    ``between`` the sides (``right`` or not). Rows that a link has joined are of one root from then on.
    """
    roots, sizes = roots.copy(), np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(ids), bool)
    for i in range(len(lines)):
        other = i + 1 + np.flatnonzero((roots[i + 1:] != roots[i]) & ((right[i + 1:] != right[i]) if between else True))
        other = other[similarity * np.maximum(sizes[other], sizes[i]) <= np.minimum(sizes[other], sizes[i])]
        near = other[np.bitwise_count(lines[other] ^ lines[i]).sum(axis=1, dtype=np.int64) <= most]
        if not len(near):
            continue
        mine = ids[ends[i] - sizes[i]:ends[i]]
        marked[mine] = True
        hits = np.append(0, np.cumsum(marked[np.concatenate([ids[ends[k] - sizes[k]:ends[k]] for k in near])]))[np.append(0, np.cumsum(sizes[near]))]
        marked[mine] = False
        both = np.diff(hits)
        for k in near[both >= similarity * (sizes[near] + sizes[i] - both)].tolist():
            if roots[k] != roots[i]:
                roots[roots == roots[k]] = roots[i]
                yield i, k


def linked_across(rows: DataFrame, similarity: float = SIMILAR, shingle: int = WORDS) -> DataFrame:
    """Links (a, b) that join rows of different ``root`` inside one ``whole``, of rows (key, fp, whole, root, text).

    All pairs within the Hamming distance of ``similarity`` are compared by their whole sets of shingles. A whole is cut
    into packs bounded in rows and in bytes of shingles; each pair of packs is a group of its own, which returns a forest
    of its links, so that a whole of n rows costs n^2 / 2 comparisons in kernels but never a row per pair.
    """
    made = materialize(per_row(rows, "key whole root fp text", "key long, whole long, root long, fp binary, shingles binary",
                               lambda k, w, r, f, t: (k, w, r, f, np.unique(shingle_hashes(t, shingle)).tobytes())))
    size = made.groupBy("whole").agg(F.greatest(F.ceil(F.count(F.lit(1)) / WHOLE), F.ceil(F.sum(F.length("shingles")) / SHINGLES)).cast("int").alias("packs"))
    dealt = made.join(size, "whole").withColumn("p", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    dealt = dealt.select("key", "root", "fp", "shingles", "p", "whole", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        lines = np.frombuffer(b"".join(rows["fp"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
        keys, lo, hi = rows["key"].to_numpy(), group[1].as_py(), group[2].as_py()
        found = [*_across(lines, rows["root"].to_numpy(), rows["p"].to_numpy() == hi, lo != hi, sets, farthest(64 * lines.shape[1], similarity), similarity)]
        edges = np.sort(keys[np.array(found, np.int64).reshape(-1, 2)], axis=1)
        return pa.Table.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    return dealt.groupBy("whole", "lo", "hi").applyInArrow(run, "a long, b long")


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILAR, shingle: int = WORDS) -> DataFrame:
    """Links (a, b) whose texts (key, text) have shingle sets of at least ``similarity``, compared in full."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # one pair of texts as Python objects at once
                u, v = (np.unique(shingle_hashes(t.as_py(), shingle)) for t in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.select(F.col("key").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    return edges.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WORDS) -> DataFrame:
    """(doc_id, key, root) for every row of ``docs`` (doc_id, text): rows with one root are near copies of each other.

    Texts link at a Jaccard similarity of their word shingles of ``similarity`` or more, tested on the whole texts of the
    pairs that blocks of long fingerprints bring together; a root names what links connect, equal texts always included.
    Texts without words are one group. Key is a hash of the text.
    """
    with small_batches(docs.sparkSession):
        keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
        rows = materialize(per_row(keyed, "doc_id key text", "doc_id long, key long, fp binary", lambda i, k, t: (i, k, long_fingerprint(t, shingle))))
        prints = materialize(rows.groupBy("key").agg(F.first("fp").alias("fp")))
        edges = materialize(candidate_links(prints, similarity))

        def texts(ends: DataFrame) -> DataFrame:
            return materialize(keyed.select("key", "text").join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))

        ends = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
        links_ = materialize(verified(edges, texts(ends), similarity, shingle))
        roots = materialize(components(links_))
        # Where a link of a forest fell, others that the forest left out may still join its parts: all of them are tested.
        whole = components(edges).withColumnRenamed("root", "whole").join(roots, "node", "left").select(F.col("node").alias("key"), "whole", F.coalesce("root", "node").alias("root"))
        whole = materialize(whole)
        fallen = whole.groupBy("whole").agg(F.min("root").alias("least"), F.max("root").alias("last")).filter("least < last").select("whole")
        open_ = materialize(whole.join(fallen, "whole", "left_semi"))
        if not open_.isEmpty():
            across = linked_across(open_.join(prints, "key").join(texts(open_.select("key")), "key"), similarity, shingle)
            roots = components(links_.unionByName(across))
    return rows.select("doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WORDS) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group of ``near_copies``, the row with the smallest doc_id stays.

    Among rows with that doc_id the one with the smallest text hash stays, and a row that is repeated stays once. Rows
    without a doc_id stay only where their group has no other. Groups are told apart by their root and not by a doc_id,
    which may be null or repeated. A very long text is compared as any other; an empty table gives an empty table. All
    columns of ``docs`` are returned, whatever their names.
    """
    found = near_copies(docs, similarity, shingle)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("c")).select("c.doc_id", "c.key")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    kept = keyed.join(chosen, keyed["_id"].eqNullSafe(chosen["doc_id"]) & (keyed["_key"] == chosen["key"]), "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select("_row.*")
