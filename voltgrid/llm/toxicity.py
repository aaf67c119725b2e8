"""Toxic terms, misspelled ones too: Levenshtein automata meet a lexicon trie, and the words around decide."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.llm.tables import append

#: Labelled rows that the lexicon is learned from, at most; those with the smallest hash of their id.
SAMPLE = 20_000
#: A term's log-likelihood ratio against the share of toxic rows, and its share of toxic uses, at least.
EVIDENCE, PRECISION = 27.0, 0.9
STEMS = (4, 5, 6)
#: Words of a stem, at least.
FAMILY = 3
EDITS = 1
#: Terms shorter than this are taken letter by letter only.
FUZZY_LENGTH = 5
FUZZY, QUOTED, UNSURE, THRESHOLD = 0.9, 0.35, 0.65, 0.7
WINDOW = 5
#: Distinct words that a task remembers, at most.
REMEMBERED = 400_000
EDGE = ".,;:!?()[]{}<>*#$%&|/\\+=-_~^`\"'“”„‘’«»…"
QUOTES = "\"“”„«»"
#: Words that report what others said.
REPORTING = frozenset({"said", "says", "called", "calls", "quote", "quoted", "quotes", "word", "term", "slur", "wrote", "insult", "insults"})


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lexicon:
    """Terms and stems with weights; finds the best weight of a word."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], exempt: frozenset[str] = frozenset(), unsure: frozenset[str] = frozenset(), edits: int = EDITS) -> None:
        self.terms, self.stems, self.exempt, self.edits = terms, stems, exempt, edits
        self.trie: dict = {}
        self.heads: dict[int, set[str]] = defaultdict(set)
        self.tails: dict[int, set[str]] = defaultdict(set)
        for t in terms:
            if len(t) >= FUZZY_LENGTH and t not in unsure:
                node = self.trie
                for ch in t:
                    node = node.setdefault(ch, {})
                node[""] = t
                for i in range(edits + 1):  # of edits + 1 parts one is untouched; the first and last stand at the word's ends
                    a, b = len(t) * i // (edits + 1), len(t) * (i + 1) // (edits + 1)
                    if i == 0:
                        self.heads[b].add(t[:b])
                    elif i == edits:
                        self.tails[b - a].add(t[a:b])

    def near(self, word: str) -> list[str]:
        """Terms within ``edits`` edits: the word's Levenshtein automaton walks the trie.

        Bit i of state e: i letters of the word are read with e edits. A branch ends when no state is left.
        """
        at: dict[str, int] = defaultdict(int)
        for i, ch in enumerate(word):
            at[ch] |= 1 << i
        end, full = 1 << len(word), (2 << len(word)) - 1
        start = [1]
        for _ in range(self.edits):
            start.append(start[-1] | start[-1] << 1)
        found, stack = [], [(self.trie, [s & full for s in start])]
        while stack:
            node, state = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if state[-1] & end:
                        found.append(child)
                    continue
                hit = at.get(ch, 0)
                new = [(state[0] & hit) << 1]
                for e in range(1, self.edits + 1):
                    new.append(((state[e] & hit) << 1 | state[e - 1] | state[e - 1] << 1 | new[-1] << 1 | new[-1]) & full)
                if new[-1]:
                    stack.append((child, new))
        return found

    def weight(self, word: str) -> float:
        """How surely a use of the word is toxic: its own weight, its stem's, or that of a term it misspells; else 0."""
        word = word.strip(EDGE)
        best = max([self.terms.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
        if best or len(word) < FUZZY_LENGTH - self.edits or word in self.exempt:
            return best
        if self.edits > 1 or any(word[:n] in s for n, s in self.heads.items()) or any(word[-n:] in s for n, s in self.tails.items()):
            return max([FUZZY * self.terms[t] for t in self.near(word)], default=0.0)
        return 0.0


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.clean, self.hot = lexicon, set(), {}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places of toxic words and their weights. Words met before are not looked up again."""
        distinct = set(words)
        for w in [w for w in distinct if w not in self.clean and w not in self.hot]:
            if (x := self.lexicon.weight(w)) > 0:
                self.hot[w] = x
            else:
                self.clean.add(w)
        some = {w for w in distinct if w in self.hot} if self.hot else set()
        out = [(i, self.hot[w]) for i, w in enumerate(words) if w in some] if some else []
        if len(self.clean) + len(self.hot) > REMEMBERED:
            self.clean, self.hot = set(), {}
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[str, float]]]:
        """1 - product of (1 - weight) over the uses; a use that is quoted or reported weighs ``QUOTED`` of its own."""
        words, miss, used = tokens(text), 1.0, []
        for i, x in self.hits(words):
            before, after = words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW]
            x *= QUOTED if quoted(before, words[i], after) else 1.0
            miss *= 1.0 - x
            used.append((words[i].strip(EDGE), x))
        return 1.0 - miss, used


def quoted(before: list[str], word: str, after: list[str]) -> bool:
    """Does the word stand between quotation marks in its window, or after a reporting word?"""
    opened = any(c in QUOTES for w in before for c in w[:1]) or word[:1] in tuple(QUOTES)
    closed = any(c in QUOTES for w in after for c in w.rstrip(".,;:!?")[-1:]) or word.rstrip(".,;:!?")[-1:] in tuple(QUOTES)
    return (opened and closed) or any(w.strip(EDGE) in REPORTING for w in before)


def learned_from(held_out: int = 1, of: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != held_out, F.lit(False))


def keys_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from at most ``sample`` labelled rows (label 0 or 1 in ``toxic``, where ``usable`` holds).

    Evidence for a term, and for a stem with ``FAMILY`` words at least, is the number of toxic texts that use it between
    different neighbours, so copies of a text count once. Kept are terms far commoner in toxic texts than chance allows.
    A term whose stem clean texts use too is ``UNSURE``: one use of it is not enough, and no misspelling of it counts.
    Words of clean texts that merely resemble a term are exempt. No labels give an empty lexicon. The sample bounds all
    that is collected here.
    """
    ids = (labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = materialize(docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"))
    share = rows.agg(F.avg("toxic")).first()[0]
    if not share or share == 1.0:
        return Lexicon({}, {})

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = ["", *(w.strip(EDGE) for w in tokens(text)), ""]
                out.update((k, w, doc_id, f"{x} {y}") for x, w, y in zip(words, words[1:], words[2:]) if w for k in keys_of(w))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "word", "doc_id", "around"])

    counted = rows.filter("toxic = 1").mapInArrow(uses, "key string, word string, doc_id long, around string").groupBy("key").agg(
        F.least(F.count_distinct("doc_id"), F.count_distinct("around")).alias("pos"), F.count_distinct("word").alias("family"))
    least = EVIDENCE / (2 * math.log(1 / share))
    toxic = {r["key"]: (r["pos"], r["family"]) for r in counted.filter(F.col("pos") >= least).collect()}
    asked = frozenset(toxic) | {k for t in toxic for k in keys_of(t) if not t.endswith("*")}

    def clean_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                n.update(asked & {k for w in {w.strip(EDGE) for w in tokens(text)} for k in keys_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["key", "n"])

    clean = dict(rows.filter("toxic = 0").select("text").mapInArrow(clean_uses, "key string, n long").groupBy("key").agg(F.sum("n")).collect())
    terms, stems, unsure = {}, {}, set()
    for key, (pos, family) in toxic.items():
        neg = clean.get(key, 0)
        p = pos / (pos + neg)
        evidence = 2 * (pos * math.log(p / share) + (neg * math.log((1 - p) / (1 - share)) if neg else 0.0))
        if p < PRECISION or evidence < EVIDENCE:
            continue
        w = (pos + 1) / (pos + neg + 2)
        if key.endswith("*"):
            if family >= FAMILY:
                stems[key[:-1]] = w * (UNSURE if neg else 1.0)
        else:
            stem = max((k for k in keys_of(key)[1:] if len(k) <= 6), key=len, default=key)
            if clean.get(stem, 0):
                unsure.add(key)
            terms[key] = w * (UNSURE if key in unsure else 1.0)
    first = Lexicon(terms, stems, unsure=frozenset(unsure))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(first)
        for b in batches:
            texts = [[w.strip(EDGE) for w in tokens(t)] for t in b.column("text").to_pylist()]
            found = {words[i] for words in texts for i, _ in scorer.hits(words)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    seen = rows.filter("toxic = 0").select("text").mapInArrow(alike, "word string").distinct().collect()
    return Lexicon(terms, stems, frozenset(r["word"] for r in seen) - terms.keys(), frozenset(unsure))


ADDED = "score double, hits array<struct<term: string, weight: double>>"


def detect(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with ``score`` and ``hits`` of each whole text.

    Only the text decides. Null and empty texts score 0; very long texts are scanned whole; repeated rows have equal
    scores, and of equal hits the first counts; columns named like the new ones are replaced; an empty table gives an
    empty table.
    """
    held: list[Scorer] = []

    def fn(texts: list[str | None]) -> list[list]:
        if not held:
            held.append(Scorer(lexicon))
        rows = [held[0].score(t) for t in texts]
        return [[r[0] for r in rows], [r[1] for r in rows]]

    return append(docs, docs.columns if keep is None else keep, ADDED, fn)
