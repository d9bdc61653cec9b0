"""Language identification: the automaton, the parse, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from pondlake.llm import langid
from tests.llm import helpers as h


def _text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"aa": ["the", "of", "thing", "water", "when"], "bb": ["der", "wasser", "und", "wenn", "ding"], "cc": ["água", "quando", "coisa", "não"]}


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(0)
    text = [rng.randrange(3) for _ in range(60)]
    go = langid.automaton(text)
    subs = {tuple(text[i:j]) for i in range(61) for j in range(i + 1, min(61, i + 8))}

    def accepts(s):
        state = 0
        for c in s:
            if c not in go[state]:
                return False
            state = go[state][c]
        return True

    assert all(accepts(s) for s in subs)
    for _ in range(2000):
        s = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        assert accepts(s) == (s in subs)


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(1)
    model = langid.fit({k: _text(rng, w, 80) for k, w in WORDS.items()})
    texts = [_text(rng, w, n) for w in WORDS.values() for n in (1, 5, 300)] + ["", "123 !!", "漢字 thing", "ZZZ the the"]
    got, sizes, letters = langid.phrases(model, texts)
    for k, lang in enumerate(model.langs):
        rng2 = random.Random(1)
        sample = {k: _text(rng2, w, 80) for k, w in WORDS.items()}
        ref = "".join(map(chr, langid._symbols([sample[lang]], model.symbols)[0]))
        for i, t in enumerate(texts):
            s = "".join(map(chr, langid._symbols([t], model.symbols)[0]))
            n = 0
            for at in range(0, len(s), langid.SEGMENT):
                part, j = s[at:at + langid.SEGMENT], 0
                while j < len(part):
                    e = j
                    while e < len(part) and part[j:e + 1] in ref:
                        e += 1
                    j = max(e, j + 1)
                    n += 1
            assert got[k, i] == n, (lang, t[:40])
    assert letters[texts.index("")] == 0 and letters[texts.index("123 !!")] == 0


def test_predictions_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, _text(rng, WORDS[k], rng.randrange(20, 200)), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, F.lit(True)))
    test = [(1000 + i, _text(rng, WORDS[k], n), k) for i, (k, n) in enumerate((k, n) for k in WORDS for n in (3, 30, 3000))]
    test += [(2000, None, None), (2001, "", None), (2002, "12 34 !", None), (2003, "x" * 300_000, None), (None, "the water", "aa")]
    out = langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[i][0] == k for i, _, k in test if k)
    assert all(got[i] == ("und", 0.0) for i in (2000, 2001, 2002)) and got[2003][0] in WORDS
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(h.empty(spark), model).count() == 0
    nothing = langid.identify(docs, None).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.sample(docs, F.lit(False)) == {}


def test_one_language(spark):
    model = langid.fit({"aa": "the water of the thing"})
    assert langid.predict(model, ["water", "7"]) == (["aa", "und"], [1.0, 0.0])


def test_held_out_accuracy(spark):
    from pondlake.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_cross_parsing"](spark, d).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_a_tiny_sample_does_not_win():
    rng = random.Random(6)
    samples = {k: _text(rng, w, 3000) for k, w in WORDS.items()}
    texts = [" ".join(rng.choice(WORDS["aa"]) + rng.choice("etaoin") for _ in range(60)) for _ in range(20)]
    assert langid.predict(langid.fit(samples | {"zz": "ok"}), texts)[0] == ["aa"] * 20


def test_no_letter_is_und_in_any_script():
    model = langid.fit({k: " ".join(w) * 9 for k, w in WORDS.items()})
    lang, score = langid.predict(model, ["😀😀", "。。", "　", "１２３ …", "\u2603", "文", "é"])
    assert lang[:5] == ["und"] * 5 and score[:5] == [0.0] * 5
    assert "und" not in lang[5:]


def test_scripts_with_many_letters():
    """More letters than the dense table has: Chinese and Japanese are told apart."""
    rng = random.Random(3)
    zh = [chr(0x4E00 + i) for i in range(0, 3000, 7)]
    ja = [chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + i) for i in range(3, 3000, 11)]
    words = {"zh": ["".join(rng.choice(zh) for _ in range(3)) for _ in range(300)],
             "ja": ["".join(rng.choice(ja) for _ in range(3)) for _ in range(300)], **WORDS}
    model = langid.fit({k: _text(rng, w, 1500) for k, w in words.items()})
    assert len(model.rare) > 100
    texts = [(k, _text(rng, w, 30)) for k, w in words.items() for _ in range(10)]
    assert langid.predict(model, [t for _, t in texts])[0] == [k for k, _ in texts]


def test_equal_languages_go_to_the_first_name():
    model = langid.fit({"b": "one two three", "a": "one two three"})
    assert langid.predict(model, ["two one"])[0] == ["a"]
