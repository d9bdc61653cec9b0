"""Piece codec against the library itself."""

import hashlib
import random

import pytest
import sentencepiece

from pondlake.llm import piece_codec as pc
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def codec():
    return pc.PieceCodec(pc.default_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.default_path())


def same(codec, library, texts):
    for text, (ids, decimals) in zip(texts, codec.encode(texts)):
        assert ids == library.encode(text, add_eos=True), text[:80]
        assert decimals == " ".join(map(str, ids))
        assert codec.decode(ids) == library.decode(ids)


def test_fixed_texts(codec, library):
    same(codec, library, ["", " ", "  a  b ", "▁a", "a▁▁b", "a\x00b", "\t\n x", "ﬁ é é Ａ", "<s> </s> <unk> <0x41>", "😀😀", "a\r\nb",
                          "　x\xa0y", "￿", "a￿ b￿c", " ,", "a,b.c\n\nd", "word, word. word\n", ", , ", "執벨ゼ梦 " * 9])


def test_random_texts(codec, library):
    rng = random.Random(5)
    alphabets = ["aeinorst ", "▁ a", "éèàüöß abc.", "日本語中文字一二三 ", " \t\nxy", "0123456789.,-", "ΑΒγδ абвг", "😀🎉é", "ab,;:!? "]
    same(codec, library, ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in alphabets for _ in range(150)])
    pieces = list(codec.pieces.values())
    same(codec, library, ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(2000)])


def test_segmentation_of_whole_texts_equals_that_by_words(codec):
    rng = random.Random(6)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("aeinorst▁.,") for _ in range(80))
        ids = [i for i, _ in codec.encode([text[1:]])][0][:-1]
        assert [i for i in codec.segment([text])[0]] == ids


def test_very_long_texts_without_a_blank(codec, library):
    rng = random.Random(7)
    same(codec, library, ["a" * 50_000, "".join(rng.choice("abcdefghij") for _ in range(50_000)), " " * 3000, "\n" * 3000])


def test_compatibility_is_what_the_merges_do(codec, library):
    """Two pieces are compatible if and only if the library leaves them as they are."""
    rng = random.Random(8)
    plain = [i for i, p in codec.pieces.items() if p.startswith("▁") and p != "▁" and "▁" not in p[1:]]
    rest = [i for i, p in codec.pieces.items() if "▁" not in p]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(rest)
        text = (codec.pieces[a] + codec.pieces[b])[1:]
        assert codec.compatible(a, b) == (library.encode(text) == [a, b])


def test_documents(spark, library):
    docs = h.awkward(spark)
    out = pc.encode_documents(docs).collect()
    want = sorted(((r[0] is None, r[0] or 0), tuple(library.encode(r[1] or "", add_eos=True))) for r in h.awkward_rows())
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r.ids)) for r in out) == want
    for r in out:
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == h.sha(r.decoded)
    bare = pc.encode_documents(docs, with_ids=False).filter("ids is null and decoded is null")
    assert bare.count() == len(out)


def test_empty_table(spark):
    assert pc.encode_documents(h.empty(spark)).count() == 0


def test_caches_are_emptied_without_change(codec, library, monkeypatch):
    monkeypatch.setattr(pc, "CACHED", 5)
    same(codec, library, [h.prose(random.Random(k), 50, 10**6) for k in range(20)])


def test_only_runs_whose_longest_pieces_do_not_fit_are_backtracked(library, monkeypatch):
    codec, laid = pc.PieceCodec(pc.default_path()), []
    real = codec._lay
    monkeypatch.setattr(codec, "_lay", lambda *a: laid.append(a[0][a[2]:a[3]]) or real(*a))
    whole = [p[1:] for p in codec.found if p[0] == pc.BLANK and p[1:].isascii() and p[1:].isalpha()][:500]
    same(codec, library, [" ".join(whole)] * 2)
    assert not laid  # each word is one piece
    same(codec, library, [h.prose(random.Random(k), 50, 10**6) for k in range(20)])
    assert len(laid) < len(codec.runs)
    before = len(laid)
    same(codec, library, [h.prose(random.Random(k), 50, 10**6) for k in range(20)])
    assert len(laid) == before  # runs and words met before are looked up
