import re

import numpy as np

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import pii

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
TEXTS = ["mail a.b+c@x-y.example.org, a@b@c.de x@y a@b.c@d.e_f@g.h. ünï@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0010.001.255.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 79927398713 " + "1" * 40,
         "+1 (499) 555-6503 +12 +49.30.1234567-- +1 ... 2", "", None, "日本 a@b.cd 日本 +1 234 567 890", "@ + 1.1 a@", "a" * 20_000 + "@b.c " + "1 " * 9_000]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return [(PLAIN[k][0], a, b) for a, k, b in sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(kind, m.group()))]


def test_base_spans_match_a_plain_search(spark):
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(TEXTS)], SCHEMA).unionByName(awkward(spark))
    out = pii.find(df).collect()
    texts = {repr(r.doc_id) + str(len(r.text or "")): r.text for r in df.collect()}
    assert len(out) == df.count() and len(texts) <= len(out)
    rows = sorted((repr(r.doc_id), [tuple(s) for s in r.spans if not s.kind.startswith("like_")]) for r in out)
    assert rows == sorted((repr(r.doc_id), plain(r.text)) for r in df.collect())
    assert sum(len(s) for _, s in rows) == 13
    assert pii.find(empty(spark)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [row(i, f"please write kontakt: user{i}@mail.org today, item {i} of the list") for i in range(12)]
    rows += [row(100, "please write kontakt: user7(at)mail.org today"), row(101, "item 7 of the list"), row(102, "phone us")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(s.kind, s.start, s.end) for s in found[100]] == [("like_email", 22, 39)]
    assert found[101] == [] and found[102] == [] and all(len(found[i]) == 1 for i in range(12))


def test_only_dataframe_functions(spark):
    df = awkward(spark)
    plan = pii.find(df)._jdf.queryExecution().toString() + pii.scanned(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_contexts_are_followed_to_the_end(spark):
    hops = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [f"alpha user{i}@mail.org" for i in range(20)] + [f"{a} v{i}-{a}" for a in hops for i in range(4)]
    texts += [f"{b} v{i}-{a}" for a, b in zip(hops, hops[1:], strict=False) for i in range(4) for _ in range(5)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert all(found[i] == ["email" if i < 20 else "like_email"] for i in range(len(texts)))


def planted(n=400):
    """Documents with identifiers of known form, of unseen form, and numbers that are none; and the unseen ones."""
    rng = np.random.default_rng(4)
    filler = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    prose = lambda k: " ".join(rng.choice(filler, k))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    rows, hidden = [], []

    def add(lead, value, tail, kind=None):
        head = f"{prose(int(rng.integers(1, 9)))} {lead} "
        if kind:
            hidden.append((len(rows), kind, len(head), len(head) + len(value)))
        rows.append(row(len(rows), f"{head}{value}{tail} {prose(4)}"))

    for i in range(n):
        add("contact me at", f"user{i}@mail{i % 9}.org", ",")
        add("please call", f"+1 ({num(3)}) 555-{num(4)}", " today")
        add("logged in from", f"{rng.integers(1, 255)}.{rng.integers(0, 255)}.{rng.integers(0, 255)}.{rng.integers(1, 255)}", "")
        add("room", num(3), " of the house")
        add("version", f"{num(1)}.{num(2)}", " of")
        add("token", num(10) + "abcdef", "")
        if i % 10 == 0:
            add("contact me at", f"user{i}(at)mail{i % 9}(dot)org", ",", "like_email")
            add("please call", f"({num(3)}) 555 {num(4)}", " today", "like_phone")
            add("logged in from", f"{rng.integers(300, 900)}.{num(2)}.{num(3)}.{num(2)}", "", "like_ip")
            add("note", f"+1 ({num(3)}) 555-{num(4)} 10.0.{i % 200}.1", "", "like_phone")
            hidden[-1] = (*hidden[-1][:3], hidden[-1][2] + 17)
    return rows, hidden


def test_recall_and_precision_of_unseen_identifiers(spark):
    rows, hidden = planted()
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect() for s in r.spans if s.kind.startswith("like_")}
    want = set(hidden)
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    assert all(b - a >= 5 for _, _, a, b in got)


def test_pattern_scores_match_a_plain_version(spark):
    rows, _ = planted(40)
    items = [(r.doc_id, i) for r in pii.scanned(spark.createDataFrame(rows, SCHEMA)).collect() for i in r["items"]]
    with_patterns = spark.createDataFrame([(d, tuple(i)) for d, i in items], "doc_id long, item struct<start: int, value: string, left: string, right: string, k: int>")
    uses = [(r.doc_id, r.item, {tuple(p) for p in r.p}) for r in with_patterns.select("doc_id", "item", pii.patterns(pii.F.col("item")).alias("p")).collect()]
    known = {}
    for _, i, _ in uses:
        if i.k is not None:
            known[i.value] = min(i.k, known.get(i.value, 9))
    while True:
        news = {}
        for p in {p for _, i, ps in uses if i.k is None for p in ps}:
            here = [i for _, i, ps in uses if p in ps]
            for kind in range(4):
                hits = [i for i in here if (i.k if i.k is not None else known.get(i.value)) == kind]
                if len({i.value for i in hits}) >= 3 and len(hits) >= 0.8 * len(here):
                    for i in here:
                        if i.k is None and len(i.value) >= pii.KINDS[kind].least:
                            news[i.value] = max(news.get(i.value, (0, 0)), (len(hits) / len(here), -kind))
        then = dict(known)
        for v, (_, kind) in news.items():
            then[v] = min(-kind, known.get(v, 9))
        if then == known:
            break
        known = then
    want = sorted((d, i.start, known[i.value]) for d, i, _ in uses if i.k is None and i.value in known)
    out = pii.bootstrapped(with_patterns.select("doc_id", "item", "item.k")).collect()
    assert want and sorted((r.doc_id, r["item"].start, r.k) for r in out) == want
