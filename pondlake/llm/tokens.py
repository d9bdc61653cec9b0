"""Token ids of whole texts by a public tokenizer file, word by word with a cache.

The tokenizer never joins characters across white space, so the ids of a text are
those of its white-space-separated words in order. Words are split and
dictionary-coded by Arrow; the tokenizer sees each distinct word once per worker
while the bounded cache holds it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached words per worker; the cache is emptied when full.
CACHED_WORDS = 300_000
#: A word of letters up to U+024F, with a run of marks after it: two pieces of
#: the tokenizer's own pattern, so both parts can be looked up on their own.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?#$%&*()|\-]*)\Z")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``
    for a tokenizer that splits at white space and has no special string in the text
    (a text that has one is encoded whole)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}  # ids as unsigned 32-bit numbers
        self.marks: dict[str, bytes] = {"": b""}
        # how the byte-level step writes each byte
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(kept)]
        self.bytes = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, word: str) -> bytes:
        """Ids of a word in ASCII lower case that is not cached. A word of letters is
        cached; one with marks after it is put together from both parts each time."""
        found = _PLAIN.match(word)
        if not found:
            return array("I", self._encode(word)).tobytes()
        core, marks = found[1], found[2]
        ids = self.words.get(core)
        if ids is None:
            plain = core
            if not core.isascii():
                plain = unicodedata.normalize("NFC", core).lower()
                plain = "".join(map(self.bytes.__getitem__, plain.encode()))
            ids = self.words[core] = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
        if not marks:
            return ids
        if marks not in self.marks:
            self.marks[marks] = array("I", self._encode(marks)).tobytes()
        return ids + self.marks[marks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one after the other, and the bounds of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        # joined with nothing to be copied: ascii_lower misreads the buffers of a slice
        low = pc.ascii_lower(pa.concat_arrays([texts, texts.slice(0, 0)]))  # the tokenizer lower-cases too
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(low)
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        words, table = self.words, []
        for w in distinct:
            ids = words.get(w)
            if ids is None:
                ids = self._new(w)
            table.append(ids)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.uint32)
        begins = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        lens = sizes[codes]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[codes] - (ends - lens), lens)
        ids = flat[at]
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        bounds = np.concatenate([[0], ends])[offsets]
        if whole.any():
            parts = [np.array(self._encode(texts[i].as_py()), np.uint32) if whole[i] else ids[bounds[i]:bounds[i + 1]]
                     for i in range(len(texts))]
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)


def batches_of(texts: pa.Array, characters: int = 2 << 20):
    """Ranges of rows of about so many bytes of text, to bound what one step holds."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + characters, "right")))
        yield first, last
        first = last
    pa.default_memory_pool().release_unused()
