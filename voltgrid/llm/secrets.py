"""Secret scans: trigram queries from the rules, postings over segments of documents, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as op
from re import _parser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.llm.tables import append

#: Bytes of text that one segment of the index holds, about.
SEGMENT = 2_000_000
#: Strings that an exact part of a rule may stand for before it is cut.
EXACT = 64


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` characters; other matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What stands between the lines of a key: white space, also escaped, and marks of quoting.
_GAP = r"""(?:[\s>|#*"'+,;]|\\[nrt])++"""
#: A private key: its header, then all up to the END line before the next BEGIN, or, without END, the lines of base64.
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
        rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):\x20*[^\s\\\"]++)*+(?:(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
        rf"(?:{_GAP}[A-Za-z0-9+/]++(?:={{1,2}}|(?=[\x20\t]*(?:[\r\n\"']|\\[nr]|\Z))))?)?)")
#: Published formats of access tokens and keys.
FORMATS = (
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", _PEM),
)
RULES = BASE + FORMATS

#: A query is True (no trigram is mandatory) or alternatives, each a set of trigrams that must all occur.
Query = bool | frozenset[frozenset[bytes]]


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= EXACT else min(a, b, key=len)


def _either(parts: Iterable[Query]) -> Query:
    out: frozenset[frozenset[bytes]] = frozenset()
    for p in parts:
        if p is True:
            return True
        out |= p
    return out


def _of(strings: set[str]) -> Query:
    """The trigrams of strings of which one must occur."""
    sets = [frozenset(w[i:i + 3] for i in range(len(w) - 2)) for w in (s.encode() for s in strings)]
    return frozenset(sets) if all(sets) else True


def _exact(code: object, arg: object) -> set[str] | None:
    """All strings, in lower case, that an element stands for, if they are few."""
    if code is op.LITERAL:
        return {chr(arg).lower()}
    if code is op.AT:
        return {""}
    if code is op.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is op.LITERAL:
                chars.add(chr(value).lower())
            elif kind is op.RANGE and value[1] - value[0] < 16:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 16 else None
    if code is op.SUBPATTERN:
        return _joined(arg[-1])
    if code is op.BRANCH:
        parts = [_joined(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 2:
        one = _joined(arg[2])
        return None if one is None else _bounded({"".join(t) for n in range(arg[0], arg[1] + 1) for t in _powers(one, n)})
    return None


def _powers(one: set[str], n: int) -> list[tuple[str, ...]]:
    return [()] if n == 0 else [(*t, s) for t in _powers(one, n - 1) for s in one]


def _bounded(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= EXACT else None


def _joined(seq: Iterable) -> set[str] | None:
    out: set[str] | None = {""}
    for code, arg in seq:
        one = _exact(code, arg)
        out = None if one is None else _bounded({a + b for a in out for b in one})
        if out is None:
            return None
    return out


def _needed(seq: Iterable) -> Query:
    query: Query = True
    run: set[str] = {""}
    for code, arg in seq:
        one = _exact(code, arg)
        longer = None if one is None else _bounded({a + b for a in run for b in one})
        if longer is not None:
            run = longer
            continue
        query, run = _both(query, _of(run)), one or {""}
        if one is None and code is op.SUBPATTERN:
            query = _both(query, _needed(arg[-1]))
        elif one is None and code is op.BRANCH:
            query = _both(query, _either(_needed(p) for p in arg[1]))
        elif one is None and code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            query = _both(query, _needed(arg[2]))
    return _both(query, _of(run))


def trigram_query(rule: Rule) -> Query:
    """Lower-case trigrams that every match of the rule must hold, as alternatives; True if there are none."""
    return _needed(_parser.parse(rule.pattern))


class Scanner:
    """Segments of texts against rules, by an inverted index of the trigrams that the rules ask for."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules, self.queries = rules, [trigram_query(r) for r in rules]
        self.patterns = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        grams = {g for q in self.queries if q is not True for alt in q for g in alt}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[[int.from_bytes(g) for g in grams]] = True

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram -> sorted numbers of the texts that hold it."""
        joined = np.frombuffer(b"\xff\xff".join(texts).lower(), np.uint8).astype(np.uint32)
        if len(joined) < 3:
            return {}
        codes = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
        at = np.flatnonzero(self.wanted[codes])
        if not len(at):
            return {}
        starts = np.cumsum([0, *[len(t) + 2 for t in texts[:-1]]])
        pairs = np.unique(codes[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        grams, first = np.unique(pairs // len(texts), return_index=True)
        return {int(g).to_bytes(3): part % len(texts) for g, part in zip(grams, np.split(pairs, first[1:]), strict=True)}

    def candidates(self, query: Query, index: dict[bytes, np.ndarray], n: int) -> list[int]:
        if query is True:
            return list(range(n))
        found: set[int] = set()
        none = np.empty(0, np.int64)
        for alternative in query:
            lists = sorted((index.get(g, none) for g in alternative), key=len)
            common = lists[0]
            for more in lists[1:]:
                common = np.intersect1d(common, more, assume_unique=True)
            found.update(common.tolist())
        return sorted(found)

    def scan(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text in order of start, then of the rules; code points, end exclusive."""
        segment: list[str] = []
        size = 0
        for t in texts:
            segment.append(t or "")
            size += len(segment[-1])
            if size >= SEGMENT:
                yield from self._segment(segment)
                segment, size = [], 0
        yield from self._segment(segment)

    def _segment(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        index = self.postings([t.encode() for t in texts]) if texts else {}
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
            for i in self.candidates(query, index, len(texts)):
                spans[i].extend((m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        return [[(self.rules[k].kind, a, b) for a, k, b in sorted(s)] for s in spans]


SPANS = "spans array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with ``spans``: the secrets in each whole text.

    Per rule, matches are leftmost and do not overlap; those too short are dropped. Each rule is turned into alternatives
    of trigrams that a match must hold; a segment of about ``SEGMENT`` bytes of texts gets an inverted index of those
    trigrams, postings are intersected, and only candidates are searched. A rule without mandatory trigrams searches all
    texts. Nothing is shuffled. Null and empty texts have no spans; an empty table gives an empty table; a column named
    ``spans`` is replaced.
    """
    held: list[Scanner] = []

    def fn(texts: list[str | None]) -> list[list]:
        if not held:
            held.append(Scanner(rules))
        return [list(held[0].scan(texts))]

    return append(docs, docs.columns if keep is None else keep, SPANS, fn)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``<kind>`` and n_chars counted again. Overlapping spans fall together under the
    first kind; rows without secrets stay as they are, null and empty texts and repeated rows among them. Very long texts are
    scanned whole, other columns keep their values whatever their names, an empty table gives an empty table."""
    held: list[Scanner] = []

    def clean(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        out, at, end = [], 0, 0
        for kind, a, b in spans:
            if a >= end:
                out += [text[at:a], f"<{kind}>"]
            end = at = max(end, b)
        return text if not spans else "".join(out) + text[at:]

    def fn(texts: list[str | None]) -> list[list]:
        if not held:
            held.append(Scanner(rules))
        return [[clean(t, s) for t, s in zip(texts, held[0].scan(texts), strict=True)]]

    changed = append(docs.select(F.struct(*docs.columns).alias("row"), "text"), ["row"], "clean string", fn)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    new = {"text": F.col("clean")}
    if "n_chars" in old:
        new["n_chars"] = F.when(old["text"].eqNullSafe(F.col("clean")), old["n_chars"]).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return changed.select(*[c.alias(name) for name, c in (old | new).items()])
