import hashlib

from tests.llm.helpers import SCHEMA, awkward, empty, row
from voltgrid.llm import fingerprints as fp


def check(df):
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + ([None] if any(i is None for i, _ in rows) else [])
    out = fp.edited_fingerprints(df).collect()
    assert sorted((repr(r.doc_id), r.n_chars, r.fingerprint) for r in out) == sorted((repr(i), len(t), fp.digest(t)) for i, t in rows)
    texts = {i: [t for k, t in rows if k == i] for i in ids}
    for r in out:
        at = ids.index(r.doc_id)
        nexts = texts[ids[(at + 1) % len(ids)]] + (texts[r.doc_id] if len(texts[r.doc_id]) > 1 else [])
        edited = [fp.edit(t, n) for t in texts[r.doc_id] for n in nexts]
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edited}
        assert r.edited_fingerprint in {fp.digest(e) for e in edited}
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next in {fp.likeness(r.fingerprint, fp.digest(n)) for n in nexts}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_awkward_rows(spark):
    check(awkward(spark))
    assert fp.edited_fingerprints(empty(spark)).count() == 0


def test_borders_of_many_partitions(spark):
    check(spark.createDataFrame([row(3 * i, f"words of document {i} " * (i % 9)) for i in range(200)], SCHEMA))
    check(spark.createDataFrame([row(7, "all alone")], SCHEMA))


def test_likeness_orders_texts():
    base = " ".join(f"alpha{i * i % 97} beta{i}" for i in range(400))
    other = " ".join(f"gamma{i * 7 % 89} delta{i}" for i in range(400))
    near = base[:-200] + "something else at the end of it"
    d = fp.digest
    assert fp.likeness(d(base), d(base)) == 1.0 and fp.likeness(d(""), d("")) == 1.0
    assert fp.likeness(d(base), d(near)) > fp.likeness(d(base), d(fp.edit(base, other))) > fp.likeness(d(base), d(other))
    assert fp.likeness(d(base), d(other)) == fp.likeness(d(other), d(base))
