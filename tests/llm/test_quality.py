"""Quality rules: exact base measures, language references, what is kept."""

import random
from collections import Counter

from pondlake.llm import quality
from tests.llm import helpers as h


def judge(df, **settings):
    rows, q = quality.judged(df, carry=["doc_id"], **settings)
    return rows.select("doc_id", f"{q}.*")


def test_base_measures(spark):
    got = judge(h.awkward(spark)).collect()
    extra = [(900, "a a a a a a"), (901, "x y z x y z\n\nx y z\nx y z"), (902, "#|<> $%&* ab"), (903, "p q r s p q r t u p q r")]
    more = judge(spark.createDataFrame([(i, t, None) for i, t in extra], "doc_id long, text string, lang string")).collect()
    for rows, out in ((h.awkward_rows(), got), (extra, more)):
        want = Counter((r[0], *h.quality(r[1])) for r in rows)
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def _english(rng, n):
    common = quality.COMMON_WORDS["en"]
    out = []
    for _ in range(n):
        out.append(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))))
        if rng.random() < 0.1:
            out[-1] += "."
    return " ".join(out).capitalize()


def test_distances_part_junk_from_prose(spark):
    rng = random.Random(5)
    good = [(i, _english(rng, rng.randrange(60, 500)), "en") for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in _english(rng, 120).split()), "en") for i in range(10)]
    junk += [(1100 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in _english(rng, 150).split()), "en") for i in range(10)]
    rows = good + junk + [(2000, None, None), (2001, "", "xx")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, _ in good)
    assert not any(got[i].kept for i, _, _ in junk)
    assert got[2000].char_js is None and got[2000].base_failed


def test_stage_keeps_columns(spark):
    docs = h.awkward(spark)
    out = quality.filter_quality(docs)
    assert out.schema == docs.schema and 0 < out.count() < docs.count()
    assert quality.filter_quality(h.empty(spark)).count() == 0


def test_distance_is_a_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.3, 0.7], [0.6, 0.4])], "p array<double>, q array<double>")
    a, b, c = rows.select(quality._distance(rows.p, rows.q).alias("d"), quality._distance(rows.q, rows.p).alias("e")).collect()
    assert abs(a.d - 1) < 1e-12 and b.d == 0 and 0 < c.d < 1 and abs(c.d - c.e) < 1e-12


def test_native_plan(spark):
    plan = judge(h.awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_labelled_quality(spark):
    """Rows labelled good and long enough are kept; most labelled bad go."""
    d = "/root/testdata/sf0.01"
    out = judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.kept for r in out if r.quality == 1 and not r.base_failed)
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(bad) <= 0.2 * len(bad)


def test_common_words_judge_short_texts(spark):
    """Letters like prose, but hardly a common word: short texts too are far from their language."""
    rng = random.Random(8)
    good = [(i, _english(rng, rng.randrange(50, 500)), "en") for i in range(300)]
    common = set(quality.COMMON_WORDS["en"])
    bare = [(1000 + i, " ".join(w for w in _english(rng, 4 * n).split() if w.strip(".").lower() not in common)[:6 * n] + " the", "en")
            for i, n in enumerate((80, 110, 150, 200) * 5)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(good + bare, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, _ in good)
    assert all(not got[i].base_failed and got[i].n_words < 250 and not got[i].kept for i, _, _ in bare)


def test_labelled_quality_by_length(spark):
    """Recall on labelled bad rows at every length, and nearly all good rows kept."""
    d = "/root/testdata/sf0.1"
    out = judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    out = [r for r in out if not r.base_failed]
    good = [r.kept for r in out if r.quality == 1]
    assert sum(good) >= 0.998 * len(good)
    for least, most, share in ((50, 99, 0.8), (100, 249, 0.99), (250, 10**9, 0.99)):
        bad = [r.kept for r in out if r.quality == 0 and least <= r.n_words <= most]
        assert bad and sum(not k for k in bad) >= share * len(bad), (least, sum(bad), len(bad))


def test_repeats_are_confirmed_on_words(spark):
    """Windows of other words whose hashes agree in the bits that 40,000 words leave are no repeats."""
    filler = [f"f{i}" for i in range(40_000)]
    false = ["a7717", "b782", "c", *filler, "a253", "b3980", "c"]
    true = [*false, "a7717", "b782", "c"]
    rows = [(i, " ".join(w), None) for i, w in enumerate((false, true))]
    got = {r.doc_id: r.n_repeat_words for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: h.quality(t)[-1] for i, t, _ in rows} == {0: 0, 1: 6}
