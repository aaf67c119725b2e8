"""Personal data: patterns of known formats, and identifiers found by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

WORD = "[^\\x20\\x09-\\x0D]"
#: Distinct known values that a pattern must have held, and the share of all its uses that must hold a known value.
SUPPORT, CONFIDENT = 3, 0.8


class Kind(NamedTuple):
    name: str
    pattern: str
    #: What a text must hold at least, cheap to test.
    sign: str
    #: Characters of the shortest identifier of the kind.
    least: int


# A run of a class can only start a match where the run itself starts, or right after the last match: the look-behind and
# \\G say so, and possessive quantifiers never give back what cannot help. Both keep long texts linear and match the same.
_LOCAL, _DIGITS = "[A-Za-z0-9._%+-]", "[0-9]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 5),
    Kind("ip", rf"(?:\G|(?<!{_DIGITS}))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){11}", 12),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 10),
)
SPAN = "array<struct<start: int, k: int, end: int, value: string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its digits summed; the whole divisible by ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.|$)){4}")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Matches that are numbered together; a text of n matches takes n * STRIDE steps, not n * n.
STRIDE = 128


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches in order: a match begins where the pieces and matches before it end."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.array().cast("array<struct<start: int, value: string>>")
    size = lambda p: p["gap"] + F.length(p["value"])

    def inside(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), none.alias("found")), lambda s, p: F.struct(
            (s["at"] + size(p)).alias("at"), F.array_append(s["found"], F.struct((s["at"] + p["gap"]).alias("start"), p["value"].alias("value"))).alias("found")), lambda s: s["found"])

    def all_of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(STRIDE)), lambda i: F.slice(pairs, i + 1, F.lit(STRIDE)))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("pairs"), F.aggregate(b, F.lit(0), lambda a, p: a + size(p)).alias("n")))
        begun = F.aggregate(sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, b: F.struct((s["at"] + b["n"]).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
        return bound(begun, lambda starts: F.flatten(F.transform(blocks, lambda b, i: inside(b, F.get(starts, i)))))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda p: p["value"].isNotNull())
    return bound(pairs, lambda p: F.when(F.size(p) > 0, all_of(p)).otherwise(none))


def _found(text: Column, k: int, kind: Kind) -> Column:
    good = F.filter(places(text, kind.pattern), lambda p: _valid(kind.name, p["value"]))
    return F.transform(good, lambda p: F.struct(p["start"].alias("start"), F.lit(k).alias("k"), (p["start"] + F.length(p["value"])).alias("end"), p["value"].alias("value")))


def spans(text: Column) -> Column:
    """Base spans (start, k, end, value) in order of start, then of kind; none for null."""
    return F.array_sort(F.concat(*[F.when(text.rlike(kind.sign), _found(text, k, kind)).otherwise(F.array().cast(SPAN)) for k, kind in enumerate(KINDS)]))


#: A word that holds a digit or an at sign.
TOKEN = rf"(?<!{WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+"
#: A value without punctuation at its ends, but for what may open a number.
CORE = r"(?:\+|\()?[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
WHITE, BLANKS = "\t\n\x0b\x0c\r", " " * 5


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, items): base spans, and all identifier-like values (start, value, left, right, k) of every text.

    An item is a base span (k is its kind) or a run of words with a digit or an at sign, one blank apart, outside base
    spans (k null), without punctuation at its ends. Left and right are the one or two words around, in lower case.
    """
    text = F.coalesce("text", F.lit(""))
    gaps = F.transform(F.split(text, TOKEN, -1), lambda g: F.lower(F.translate(g, WHITE, BLANKS)))
    first = docs.select("doc_id", F.xxhash64("text").alias("key"), spans(text).alias("base"), F.when(text.rlike("[0-9@]"), F.struct(gaps.alias("gaps"), places(text, TOKEN).alias("found"))).alias("t"))
    end = lambda p: p["start"] + F.length(p["value"])
    words = F.transform("t.found", lambda p, i: F.struct(
        p["start"].alias("start"), p["value"].alias("value"), F.substring_index(F.rtrim(F.get("t.gaps", i)), " ", -2).alias("left"), F.substring_index(F.ltrim(F.get("t.gaps", i + 1)), " ", 2).alias("right"),
        F.get(F.filter("base", lambda b: (b["start"] >= p["start"]) & (b["start"] < end(p))), F.lit(0)).alias("seed")))
    outside = F.filter(words, lambda t: ~F.exists("base", lambda b: (b["start"] < t["start"]) & (b["end"] > t["start"])))

    def runs(tokens: Column) -> Column:
        def opens(t: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            return t["seed"].isNotNull() | (i == 0) | before["seed"].isNotNull() | (t["start"] != end(before) + 1) | (t["left"] != "")
        heads = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), opens(t, i).alias("open"))), lambda h: h["open"])

        def run(h: Column, j: Column, all_heads: Column) -> Column:
            size = F.coalesce(F.get(all_heads, j + 1)["i"], F.size(tokens)) - h["i"]
            head = F.get(tokens, h["i"])
            whole = F.array_join(F.transform(F.slice(tokens, h["i"] + 1, size), lambda t: t["value"]), " ")
            alone = head["seed"].isNull()
            core = F.regexp_extract(whole, CORE, 0)
            return F.struct(F.when(alone, head["start"] + F.instr(whole, core) - 1).otherwise(head["seed"]["start"]).cast("int").alias("start"),
                            F.when(alone, core).otherwise(head["seed"]["value"]).alias("value"), head["left"].alias("left"),
                            F.when(alone | (F.length(head["seed"]["value"]) <= F.length(head["value"])), F.get(tokens, h["i"] + size - 1)["right"]).otherwise(F.lit("")).alias("right"), head["seed"]["k"].alias("k"))

        return bound(heads, lambda all_heads: F.transform(all_heads, lambda h, j: run(h, j, all_heads)))

    items = F.filter(bound(outside, runs), lambda x: x["k"].isNotNull() | (F.length(x["value"]) >= min(k.least for k in KINDS)))
    return first.select("doc_id", "key", "base", items.alias("items"))


def shape(value: Column) -> Column:
    """Letters as ``a`` (a run once), digits as ``9`` each, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\p{N}", "9")


def patterns(item: Column) -> Column:
    """Lexical patterns of an item, (type, text): one or two words on a side, words on both sides, its shape, both together."""
    left, right, form = F.substring_index(item["left"], " ", -1), F.substring_index(item["right"], " ", 1), shape(item["value"])
    coarse = F.regexp_replace(form, "9+", "9")
    found = [("L", left, left != ""), ("R", right, right != ""), ("LL", item["left"], item["left"].contains(" ")), ("RR", item["right"], item["right"].contains(" ")),
             ("LR", F.concat_ws(" ", left, right), (left != "") & (right != "")), ("S", form, F.lit(True)), ("LS", F.concat_ws(" ", left, coarse), left != ""), ("RS", F.concat_ws(" ", coarse, right), right != "")]
    return F.filter(F.array(*[F.when(there, F.struct(F.lit(kind).alias("type"), text.alias("text"))) for kind, text, there in found]), lambda p: p.isNotNull())


def _state(known: DataFrame) -> tuple:
    return tuple(known.agg(F.count(F.lit(1)), F.sum("kind")).first())


def bootstrapped(uses: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Items of ``uses`` (item, k) of unknown kind (k null) that confident patterns name: with their kind ``k``.

    In the graph of patterns and values, a pattern's confidence for a kind is the share of its uses, over all items of
    the corpus, that hold a known value; it needs ``support`` different values. Values of confident patterns become
    known, wherever they occur, and patterns are scored again, until nothing changes: values are only ever added and the
    number of a value's kind only falls, so this ends. A value shorter than its kind's shortest form stays unknown.
    """
    least = F.array(*[F.lit(k.least) for k in KINDS])
    slots = uses.select(F.col("item.value").alias("value"), "k", F.explode(patterns(F.col("item"))).alias("p")).groupBy("p", "value", "k").agg(F.count(F.lit(1)).alias("held"))
    graph = materialize(slots.select("p.type", "p.text", "value", "k", "held"))
    total = materialize(graph.groupBy("type", "text").agg(F.sum("held").alias("n"), F.count_if(F.col("k").isNull()).alias("open")).filter(F.col("n") >= support))
    known = materialize(graph.filter("k IS NOT NULL").groupBy("value").agg(F.min("k").alias("kind")))
    mark, last = _state(known), None
    while mark != last:
        labelled = graph.join(known, "value", "left").withColumn("kind", F.coalesce("k", "kind"))
        scored = labelled.filter("kind IS NOT NULL").groupBy("type", "text", "kind").agg(F.sum("held").alias("hits"), F.count_distinct("value").alias("values")).filter(F.col("values") >= support)
        share = F.col("hits") / F.col("n")
        trusted = scored.join(total.filter("open > 0"), ["type", "text"]).filter(share >= confident).select("type", "text", "kind", share.alias("share"))
        news = graph.filter("k IS NULL").join(trusted, ["type", "text"]).filter(F.length("value") >= F.get(least, F.col("kind"))).groupBy("value").agg(
            F.max(F.struct(F.col("share"), (-F.col("kind")).alias("minus"))).alias("best")).select("value", (-F.col("best.minus")).alias("kind"))
        known = materialize(known.unionByName(news).groupBy("value").agg(F.min("kind").alias("kind")))
        mark, last = _state(known), mark
    return uses.filter("k IS NULL").drop("k").join(known.select(F.col("value").alias("_value"), F.col("kind").alias("k")), F.col("item.value") == F.col("_value")).drop("_value")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of every row of ``docs`` (doc_id, text): spans are (kind, start, end) in code points.

    Base kinds are matched by their formats in whole texts, leftmost and without overlap per kind; matches that fail a
    check are dropped. Bootstrapping adds identifiers of unseen form as kinds ``like_<kind>``; between patterns of one
    confidence the earlier kind wins. Null and empty texts have no spans, very long texts are taken whole, repeated rows
    have the same spans, other columns are ignored, an empty table gives an empty table.
    """
    rows = materialize(scanned(docs))
    uses = rows.select("doc_id", "key", F.explode("items").alias("item")).select("doc_id", "key", "item", "item.k")
    begin = F.col("item.start")
    span = F.struct(begin.alias("start"), (F.col("k") + len(KINDS)).cast("int").alias("k"), (begin + F.length("item.value")).alias("end"), F.col("item.value").alias("value"))
    more = bootstrapped(uses).select("doc_id", "key", span.alias("s")).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set("s").alias("more"))
    joined = rows.join(more, rows["doc_id"].eqNullSafe(more["_id"]) & (rows["key"] == more["_key"]), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    names = F.array(*[F.lit(k.name) for k in KINDS], *[F.lit(f"like_{k.name}") for k in KINDS])
    return joined.select("doc_id", "key", F.transform(every, lambda s: F.struct(F.get(names, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
