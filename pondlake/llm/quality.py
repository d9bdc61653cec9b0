"""Quality rules by distribution divergence, in DataFrame functions only.

For each document the histograms of its character classes and of its language's
common words are compared, by Jensen-Shannon distance (base 2, so 0 to 1), to
the mean histograms of its language, taken over all documents that pass the base
rules and are not far themselves. A document is rejected when either distance is
above its threshold. Short texts are far from any mean by chance: each test has a
least length, and the thresholds widen as ``char_slack`` over the number of words
and as ``word_slack`` over its square root.

One heavy pass measures every document and writes the measures (and the columns
the caller carries along) to the shared folder; the references are an aggregate
of that table with map-side combine, joined back by language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import WS, Scratch, fresh, keep_rows, sized_join, text_key, text_or_empty, words_of

#: Frequent function words by language. Languages not listed are
#: judged by character classes alone.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "rest")
#: A reference needs this many documents; else the one of all documents serves.
LEAST_REFERENCE = 20


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _measured(docs: DataFrame, text_col: str, lang_col: str | None, carry: Sequence[str]) -> DataFrame:
    """``held``, a struct of the carried columns, and ``m``, one of measures."""
    held = F.struct(*[F.col(c) for c in carry]).alias("held")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    a = docs.select(held, lang.alias("lang"), text_or_empty(text_col).alias("t"))
    a = a.select("*", words_of(F.col("t")).alias("words"), F.split("t", "\n").alias("lines"))
    a = a.select(
        "held", "lang", "t", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.filter("lines", lambda x: x.rlike(f"[^{WS[1:-1]}]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter(F.transform(F.filter("words", lambda w: F.length(w) <= 8), lambda w: F.lower(w)),
                 lambda w: w.isin(every)).alias("common"),
        # the power of two above the word count: window hashes keep the bits over it, places take those under it
        F.expr("shiftleft(1L, length(bin(size(words))))").alias("m"))
    # a window's hash with its place in the low bits: sorted, equal windows meet, and n log n suffices;
    # windows that meet are then sorted by their words, as the bits left of a long text's hashes meet by chance
    a = a.withColumn("windows", F.expr(
        "case when n_words < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(n_words as int) - 3),"
        " i -> (xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]) & -m) | i)) end"))
    a = a.withColumn("met", F.expr(
        "sort_array(transform(transform(filter(windows, (x, j) -> (j > 0 and ((x ^ windows[j - 1]) & -m) = 0)"
        " or (j < size(windows) - 1 and ((x ^ windows[j + 1]) & -m) = 0)), x -> cast(x & (m - 1) as int)),"
        " p -> named_struct('w', named_struct('a', words[p], 'b', words[p + 1], 'c', words[p + 2]), 'p', cast(p as long))))"))
    a = a.withColumn("places", F.expr(
        "sort_array(transform(filter(met, (x, j) -> (j > 0 and x.w = met[j - 1].w)"
        " or (j < size(met) - 1 and x.w = met[j + 1].w)), x -> x.p))"))
    listed = F.element_at(lists, F.col("lang"))
    symbols = _count(F.col("t"), "[^#*$%&|<>]+")
    counts = F.struct(
        F.length("t").cast("long").alias("n_chars"),
        _count(F.col("t"), r"[^\p{Ll}]+").alias("lower"), _count(F.col("t"), r"[^\p{Lu}\p{Lt}]+").alias("upper"),
        _count(F.col("t"), r"[^\p{Nd}]+").alias("digit"),
        (F.length("t") - F.col("word_chars")).cast("long").alias("space"),
        _count(F.col("t"), r"""[^.,;:!?'"()\-]+""").alias("mark"), symbols.alias("symbol"))
    a = a.select("held", "lang", "n_words", "word_chars", counts.alias("c"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.expr("aggregate(places, named_struct('last', -3L, 'n', 0L), (s, p) -> named_struct('last', p, 'n',"
                        " s.n + least(3L, p - s.last)), s -> s.n)").alias("n_repeat_words"),
                 F.when(listed.isNotNull(), F.transform(listed, lambda x: F.size(
                     F.filter("common", lambda w: w == x)).cast("double"))).alias("common"))
    total = F.greatest(F.col("c.n_chars"), F.lit(1)).cast("double")
    named = [F.col(f"c.{k}").cast("double") / total for k in CLASSES[:-1]]
    rest = F.greatest(F.lit(0.0), (F.col("c.n_chars") - sum((F.col(f"c.{k}") for k in CLASSES[:-1]), F.lit(0))) / total)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = F.transform("common", lambda x: x / n)
    measures = F.struct(
        "lang", "n_words", "word_chars", F.col("c.n_chars").alias("n_chars"), F.col("c.symbol").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", F.array(*named, rest).alias("chars"), shares.alias("common"))
    return a.select("held", measures.alias("m"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays that sum to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when((a > 0) & (b.isNotNull()), a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _whole(shares: Column) -> Column:
    """Shares with what they leave of 1 as a last entry."""
    left = F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x))
    return F.concat(shares, F.array(left))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", carry: Sequence[str] = ("doc_id",),
           least_words: int = 50, most_repeated: int = 50, char_distance: float = 0.09, char_slack: float = 12.0,
           char_least: int = 200, word_distance: float = 0.12, word_slack: float = 1.4, word_least: int = 50,
           scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """Every row of ``docs``: the carried columns and one struct of verdict columns,
    whose name is returned.

    Fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (null
    text counts as empty, all 0), ``char_js``, ``word_js`` (null where the text is
    shorter than ``char_least`` characters or ``word_least`` words, or no common
    words are listed for the language), ``base_failed`` (fewer than
    ``least_words`` words, or over ``most_repeated`` percent of the words in
    repeated three-word windows) and ``kept``. A null or rare language is
    compared to the mean of all documents. Repeated rows are judged alike.
    Windows whose hashes agree are compared by their words: the count is exact.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    measured = scratch.write(_measured(docs, text_col, lang_col, carry))
    m = measured.select("m.*")
    longest = max(map(len, COMMON_WORDS.values()))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    sound = m.filter("n_words > 0").select("lang", "chars", "common", failed.alias("failed"))

    def reference(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        mean = [F.array(*[F.avg(F.get(k, F.lit(i))) for i in range(n)]).alias(f"ref_{k}")
                for k, n in (("chars", len(CLASSES)), ("common", longest))]
        own = rows.groupBy("lang").agg(*mean, F.count("*").alias("n"))
        own = own.filter(f"lang is not null and n >= {LEAST_REFERENCE}").drop("n")
        return scratch.write(own), scratch.write(rows.agg(*mean).select(F.col("ref_chars").alias("all_chars")))

    def beside(rows: DataFrame, refs: tuple[DataFrame, DataFrame]) -> DataFrame:
        rows = sized_join(rows, refs[0], ["lang"], "left", 512).join(F.broadcast(refs[1]))  # one row
        return rows.withColumn("ref_chars", F.coalesce("ref_chars", "all_chars"))

    # first the mean of what passes the base rules, then of what is near that mean
    rough = reference(sound.filter("not failed"))
    near = beside(sound.filter("not failed"), rough)
    refs = reference(near.filter(_distance(F.col("chars"), F.col("ref_chars")) <= 2 * char_distance).select(sound.columns))
    rows = beside(measured.withColumn("lang", F.col("m.lang")), refs)
    far_chars = F.when(F.col("m.n_chars") >= char_least, _distance(F.col("m.chars"), F.col("ref_chars")))
    far_words = F.when((F.col("m.n_words") >= word_least) & F.col("m.common").isNotNull() & F.col("ref_common").isNotNull(),
                       _distance(_whole(F.col("m.common")), _whole(F.col("ref_common"))))
    rows = rows.select("held", "m", far_chars.alias("char_js"), far_words.alias("word_js"))
    failed = (F.col("m.n_words") < least_words) | (100 * F.col("m.n_repeat_words") > most_repeated * F.col("m.n_words"))
    far = F.coalesce(F.col("char_js") > char_distance + char_slack / F.col("m.n_words"), F.lit(False)) \
        | F.coalesce(F.col("word_js") > word_distance + word_slack / F.sqrt(F.col("m.n_words")), F.lit(False))
    verdict = F.struct(*[F.col(f"m.{k}").alias(k) for k in
                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       "char_js", "word_js", failed.alias("base_failed"), (~failed & ~far).alias("kept"))
    name = fresh(carry, "_quality")
    return rows.select("held", verdict.alias(name)).select("held.*", name), name


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    scratch = Scratch(docs.sparkSession, "quality")
    key = fresh([id_col], "_text_key")
    rows, q = judged(docs.withColumn(key, text_key(F.col(text_col))), text_col, lang_col, [id_col, key], scratch=scratch)
    verdict = rows.select(F.col(id_col).alias("doc_id"), F.col(key).alias("text_key"), F.col(q)["kept"].alias("kept"))
    # one verdict a pair: rows repeated with the same id and text all stay or all go
    verdict = verdict.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"))
    return keep_rows(docs, verdict, id_col, text_col, scratch)
