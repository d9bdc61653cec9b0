"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: doc_id, text, lang, source, n_chars and columns whose names clash with ours.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, row_id long, grp long,"
          " digest binary, m long, held string, key long, label long")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 260)) for _ in range(40)]
    texts: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    texts += [(100 + i, base[7]) for i in range(30)]                              # a large group of copies
    texts += [(200 + i, base[8].replace(" ", "\t \n", 1 + i)) for i in range(5)]  # equal but for white space
    words = prose(rng, 120, 4000).split()
    for i in range(25):                                                          # a large group of near copies
        own = list(words)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append((300 + i, " ".join(own)))
    long = prose(rng, 20_000, 10**6)
    texts += [(400, long), (401, long + " end"), (402, "a" * 1_500_000), (403, "b " + "a" * 1_500_000), (404, "b " + "a" * 1_500_000)]
    texts += [(500, None), (501, ""), (502, " \n\t"), (503, None), (504, "one"), (505, "ONE"), (506, "one two three four"),
              (507, "one two three four five"), (508, " "), (509, "é à ü ß İ 漢字 😀")]
    texts += [(600, base[3]), (600, base[3]), (600, base[4]), (None, base[5]), (None, base[5]), (None, "alone with no id")]
    langs, sources = ["en", "fr", None], ["a", "b", "c", "Z", None]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t), None, 1, k % 3, None, None, None, "h", 5, 6)
            for k, (i, t) in enumerate(texts)]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def exact_groups(rows) -> dict[str, list]:
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    return groups


def shingles(text: str | None) -> frozenset:
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def components(sets: list[frozenset]) -> list[int]:
    """The least index of each set's component of links of similarity 0.75 or more."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if count[tuple(w[k:k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
