import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, empty
from voltgrid.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_words_encode_like_the_whole_text():
    words = packing.WordIds(PATH)
    for text in ["it's a  test of\u0085x\x1cy ́a", "Á ́b İSTANBUL ΟΔΟΣ", "<|endoftext|> a<|startoftext|>b", "日本 12345 !!??\ttab\x0b\x0cz", "", None]:
        got = np.frombuffer(words.encode([text])[0], "<u4").tolist()
        assert [*got, 1] == whole_ids(text)


def test_pieces_cover_each_document_once(spark):
    df = awkward(spark)
    out = packing.packed(df, PATH, 2048).collect()
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(whole_ids(r.text))
    for doc_id, ids in texts.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id == doc_id)
        want = sorted((s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(i)) for i in ids for s in range(0, len(i), 2048) for p in [i[s:s + 2048]])
        assert mine == want
    assert packing.packed(empty(spark), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    df = awkward(spark).dropDuplicates(["doc_id", "text"])
    ids = b"".join(r.ids for r in packing.sequences(df, PATH).collect())
    assert sorted(np.frombuffer(ids, "<u4").tolist()) == sorted(i for r in df.collect() for i in whole_ids(r.text))


def test_first_fit_matches_a_plain_scan():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        lengths = rng.integers(1, 2049, n)
        bins, offsets = packing.first_fit(lengths, 2048)
        room = []
        want = np.empty(n, np.int64)
        for i in np.argsort(-lengths, kind="stable"):
            want[i] = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [2048] * int(want[i] == len(room))
            room[want[i]] -= lengths[i]
        assert (bins == want).all() and (offsets >= 0).all()


def test_each_copy_of_a_document_has_its_own_place(spark):
    df = awkward(spark)
    df = df.unionByName(df)
    out = packing.sequences(df, PATH).collect()
    assert all(len(r.ids) == 4 * r.tokens <= 4 * 2048 for r in out) and len({r.sequence_id for r in out}) == len(out)
    ids = b"".join(r.ids for r in out)
    assert sorted(np.frombuffer(ids, "<u4").tolist()) == sorted(i for r in df.collect() for i in whole_ids(r.text))


def test_digests_come_from_written_ids(spark):
    df = awkward(spark)
    out, cut = packing.packed(df.unionByName(df), PATH), packing.pieces(df, PATH).collect()
    assert sorted((repr(r.doc_id), r.key, r.start, bytes(r.ids), zlib.crc32(r.ids)) for r in out.collect()) == sorted((repr(r.doc_id), r.key, r.start, bytes(r.ids), zlib.crc32(r.ids)) for r in cut for _ in range(2))
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in out.collect())


def test_merged_words_encode_like_the_tokenizer():
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz") + ["é", "ß", "ñ", "ж", "ω", "a", "e", "t", "h"]
    words = ["a", "aa", "aaa", "aaaa", "aaaaa", "aaaaaaaaa", "zzzzzz", "thththth", *("".join(rng.choice(letters, int(rng.integers(1, 25)))) for _ in range(3000))]
    got, tokenizer = packing.WordIds(PATH).merges.encode([w.encode() for w in words]), Tokenizer.from_file(PATH)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert packing.WordIds(PATH).merges.encode([]) == []
