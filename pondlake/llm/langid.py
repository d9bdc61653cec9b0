"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A text is parsed against it into longest matches: each phrase is
the longest prefix of what is left that occurs in the sample. Few phrases mean
little entropy relative to that language; phrases times the log of the longest
sample's length, per character, is the normalised count, and the language with the
least wins. The log is the same for all, so that a sample of a few letters cannot win
by its small one.

Text is lower-cased; a run of anything but letters is one blank. Letters of any
script count; one that no sample has matches nothing. Texts are parsed
in segments of ``SEGMENT`` symbols, all segments of a batch and all languages in
step: one table lookup a symbol. A phrase ends at a segment's end, which costs each
language the same.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondlake.llm.common import ship

SEGMENT = 256
#: Bounds of the sample a model is fitted on: labelled documents of a language in
#: seeded order, characters from the start of each, and characters in all.
SAMPLE_DOCS, SAMPLE_PIECE, SAMPLE_CHARS = 200, 500, 20_000
#: Letters whose transitions are held in a dense table; those of rarer ones are looked up in a sorted list.
LETTERS = 120
BLANK, UNKNOWN, PAD = 0, 1, 2
_SYMBOLS = 1 << 21  # more than there are code points


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray    # code point -> symbol
    table: np.ndarray      # (state of any language, frequent symbol) -> state; 0: no match
    rare: np.ndarray       # (state, other symbol) as one number, sorted
    rare_to: np.ndarray    # the state each of them leads to
    roots: np.ndarray      # first state of each language
    weights: np.ndarray    # log2 of the longest sample's length, for each language


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: paths from state 0 spell the substrings."""
    go, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def _symbols(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, blanks collapsed, and the bounds of each text's."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in low])
    out = symbols[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep[starts[starts < len(keep)]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([[0], count[ends]]).astype(np.int64) if len(ends) else np.zeros(1, np.int64)


def fit(samples: dict[str, str]) -> Model:
    """The model of texts by language (in order of the languages' names)."""
    langs = sorted(samples)
    seen = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
    symbols = np.array([UNKNOWN if chr(i).isalpha() else BLANK for i in range(0x110000)], np.int32)
    letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    for i, c in enumerate(letters):
        symbols[ord(c)] = 3 + i
    width = 3 + min(LETTERS, len(letters))
    rows, roots, weights, rare = [np.zeros((1, width), np.int32)], [], [], {}
    for lang in langs:
        text = _symbols([samples[lang]], symbols)[0]
        text = text[text != UNKNOWN].tolist()
        go = automaton(text)
        first = sum(map(len, rows))
        block = np.zeros((len(go) + 1, width), np.int32)
        for s, edges in enumerate(go):
            for c, t in edges.items():
                if c < width:
                    block[s, c] = first + t
                else:
                    rare[(first + s) * _SYMBOLS + c] = first + t
        # a symbol that the sample lacks is a phrase of its own: the last state, which nothing follows
        block[0][block[0] == 0] = first + len(go)
        block[:, PAD] = np.arange(first, first + len(block))
        rows.append(block)
        roots.append(first)
        weights.append(len(text))
    weights = [math.log2(max(2, *weights))] * len(langs) if langs else []
    table = np.concatenate(rows)
    keys = np.array(sorted(rare), np.int64)
    return Model(langs, symbols, table.astype(np.uint16) if len(table) < 2**16 else table, keys,
                 np.array([rare[k] for k in keys.tolist()], np.int64), np.array(roots, np.int64), np.array(weights))


def _go(model: Model, state: np.ndarray, symbol: np.ndarray, dead: int) -> np.ndarray:
    """The states after a symbol each; ``dead`` where there is none."""
    width = model.table.shape[1]
    often = symbol < width
    went = model.table.ravel()[state * width + np.where(often, symbol, UNKNOWN)].astype(np.int64)
    if not often.all():
        at = np.flatnonzero(~often)
        keys = state[at] * _SYMBOLS + symbol[at]
        found = np.minimum(np.searchsorted(model.rare, keys), max(0, len(model.rare) - 1))
        met = model.rare[found] == keys if len(model.rare) else np.zeros(len(at), bool)
        went[at] = np.where(met, model.rare_to[found] if len(model.rare) else 0, dead)
    return went


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and language the number of phrases; per text its symbols and its letters."""
    flat, bounds = _symbols(texts, model.symbols)
    sizes = np.diff(bounds)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    first = np.repeat(bounds[:-1], parts) + SEGMENT * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    lens = np.minimum(SEGMENT, bounds[owner + 1] - first) if len(owner) else np.zeros(0, np.int64)
    order = np.argsort(-lens, kind="stable")
    owner, first, lens = owner[order], first[order], lens[order]
    count = np.zeros((len(model.langs), len(texts)), np.int64)
    padded = np.append(flat, PAD).astype(np.int64)
    for k, root in enumerate(model.roots):
        # of a language, the state that nothing follows: a symbol that its sample lacks leads there
        alone = int(model.table[root, UNKNOWN])
        state, made = np.full(len(first), root, np.int64), np.zeros(len(first), np.int64)
        live = len(first)
        for i in range(int(lens[0]) if len(lens) else 0):
            while live and lens[live - 1] <= i:
                live = int(np.searchsorted(-lens[:live], -i, "left"))
            c = padded[first[:live] + i]
            went = _go(model, state[:live], c, 0)
            dead = np.flatnonzero(went == 0)
            made[dead] += 1
            went[dead] = _go(model, np.full(len(dead), root, np.int64), c[dead], alone)
            state[:live] = went
        made += state != root
        count[k] = np.bincount(owner, made, len(texts)).astype(np.int64)
    letters = np.concatenate([[0], np.cumsum(flat != BLANK)])
    return count, sizes, letters[bounds[1:]] - letters[bounds[:-1]]


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language of each text and a score from 0 to 1: by how much of its own
    normalised phrase count the next language is worse. ``und`` without letters."""
    count, sizes, letters = phrases(model, texts)
    entropy = count * model.weights[:, None] / np.maximum(sizes, 1)
    order = np.argsort(entropy, 0, kind="stable")
    cols = np.arange(len(texts))
    best = entropy[order[0], cols]
    score = 1 - best / np.maximum(entropy[order[1], cols], 1e-12) if len(model.langs) > 1 else np.ones(len(texts))
    known = letters > 0
    return ([model.langs[k] if ok else "und" for k, ok in zip(order[0], known)],
            [float(min(1.0, max(0.0, s))) if ok else 0.0 for s, ok in zip(score, known)])


def sample(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
           seed: int = 29) -> dict[str, str]:
    """The bounded sample: at most SAMPLE_DOCS pieces a language reach the driver."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
               .select(F.col(lang_col).cast("string").alias("lang"), F.substring(F.col(text_col), 1, SAMPLE_PIECE).alias("piece"),
                       F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "piece")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {SAMPLE_DOCS}")
    got = pd.DataFrame([r.asDict() for r in rows.collect()], columns=["lang", "piece", "draw", "rank"])
    out = {}
    for lang, group in got.groupby("lang"):
        text = "\n".join(group.sort_values(["rank"])["piece"])[:SAMPLE_CHARS]
        if any(c.isalpha() for c in text):
            out[str(lang)] = text
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``. Null text, or text without a
    letter, is ``und`` with score 0, as is any text if there was nothing to learn from."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                texts = [t or "" for t in part.column("text").to_pylist()]
                lang, score = predict(model, texts) if model and model.langs else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
