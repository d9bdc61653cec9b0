"""SentencePiece encoding (merge type) by backtracking, and decoding.

A text's pieces are found without running its merges. Aho-Corasick matching gives
the longest piece that begins at every character. A segmentation is the one the
merges make if and only if every two adjacent pieces, merged again from their
characters, end as those two pieces; so pieces are laid left to right, longest
first, each checked against the one before it. Where none fits, the last piece is
taken back for a shorter one, and a bitfield remembers positions that failed, so
that each is tried once: work is linear in the text.

Where no piece has a blank after another character (checked when the file is read),
no merge crosses the place before a run of blanks, and a text's ids are those of
its words in order. Words are put together from runs of letters and of marks by the
same check of adjacent pieces; a bounded table holds the runs a worker has met, and
the borders and ids of a batch's runs are looked up there as arrays.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import ship
from pondlake.llm.tokens import batches_of

BLANK = "▁"  # how the vocabulary writes a blank
#: Cached runs of letters, and pairs of pieces, per worker; a cache is emptied when full.
CACHED = 800_000
#: A character that no piece has; it stands between words that are matched together.
BORDER = "\uffff"
#: Over any piece, and over -1 - any code point, as a number without sign.
PIECE = 1 << 31
_RUN = re.compile(rf"{BLANK}*[^{BLANK}\n.,;:!?]+|{BLANK}+|[\n.,;:!?]+")
#: Longer runs are encoded each time they come.
CACHED_LENGTH = 64


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class _Rows(dict):
    """Row numbers; a run that has none gets the next, and is listed as new."""

    def __missing__(self, run: str) -> int:
        row = self[run] = self.rows + len(self.new)
        self.new.append(run)
        return row


class PieceCodec:
    """Ids of texts for a merge-type vocabulary file, equal to the library's.

    The library reads the file and normalises and decodes; pieces are its ids (id 0
    is no piece), and a character that is no piece is ``-1 - code point`` until it
    is written as bytes.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        kept = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i)
                                               or self.library.is_byte(i) or self.library.is_unused(i))]
        self.pieces = {i: self.library.id_to_piece(i) for i in kept}
        self.scores = {p: self.library.get_score(i) for i, p in self.pieces.items()}
        if any(BORDER in p for p in self.scores):
            raise ValueError("a piece has the border character")
        self.reach = [len(self.pieces.get(i, " ")) - 1 for i in range(size)]  # characters after the first
        self.less = np.array(self.reach)
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_words = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces.values())
        # pieces that the merges never make (from their own characters) are no candidates
        self.histories = {i: self._history(p) for i, p in self.pieces.items()}
        self.found = {p: i for i, p in self.pieces.items() if self.histories[i] is not None}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.found.items():
            if len(p) > 1:  # a place where none begins takes its character's piece
                self.automaton.add_word(p, i)
        self.single = {p: i for p, i in self.found.items() if len(p) == 1}
        self.automaton.make_automaton()
        # the longest piece that a piece begins with
        self.shorter = {i: next((self.found[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.found), None)
                        for p, i in self.found.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.decimals = np.array([f"{i} ".encode() for i in range(size)])  # of equal width, filled with zero bytes
        self._forget()

    def _history(self, piece: str) -> list[tuple[float, int, int]] | None:
        """The merges that make a piece from its characters, in order: score, and the
        lengths of its first and last part after the merge. None if they end otherwise."""
        parts, out = list(piece), []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, len(parts[0]), len(parts[-1])))
        return out

    def _text(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else chr(-1 - piece)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges over both pieces' characters end as these two pieces.

        The merges of either side go on in order of score (the left one first where
        equal) as long as no merge across the border comes before both.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b = self._text(left), self._text(right)
        ours, theirs = self.histories.get(left, []), self.histories.get(right, [])
        i = j = 0
        last, first, fits = 1, 1, True
        while True:
            across = self.scores.get(a[-last:] + b[:first])
            mine = ours[i][0] if i < len(ours) else None
            other = theirs[j][0] if j < len(theirs) else None
            if across is not None and (mine is None or across > mine) and (other is None or across >= other):
                fits = False
                break
            if mine is None and other is None:
                break
            if other is None or (mine is not None and mine >= other):
                last, i = ours[i][2], i + 1
            else:
                first, j = theirs[j][1], j + 1
        if len(self.pairs) > CACHED:
            self.pairs = {}
        self.pairs[left, right] = fits
        return fits

    def segment(self, words: list[str]) -> list[list[int]]:
        """The pieces of normalised words, each by backtracking; the longest pieces
        are matched in one pass over all of them."""
        joined = BORDER.join(words)
        longest = [0] * len(joined)  # 0: no piece of two characters or more begins here
        less = self.reach
        for end, piece in self.automaton.iter(joined):
            longest[end - less[piece]] = piece  # longer ones end later
        out, first = [], 0
        for word in words:
            out.append(self._lay(joined, longest, first, first + len(word)))
            first += len(word) + 1
        return out

    def _lay(self, text: str, longest: list[int], at: int, stop: int) -> list[int]:
        """Pieces for the characters from ``at`` to ``stop``."""
        base, laid, failed = at, [], bytearray((stop - at) // 8 + 1)  # a bit for each position
        pairs, less, shorter, single = self.pairs, self.reach, self.shorter, self.single
        last = None
        piece = (longest[at] or single.get(text[at]) or -1 - ord(text[at])) if at < stop else None
        while at < stop:
            if piece is None:  # nothing fits: a place is reached in one way only, so this one is done with
                failed[(at - base) >> 3] |= 1 << ((at - base) & 7)
                piece = laid.pop()
                last = laid[-1] if laid else None
                at -= less[piece] + 1 if piece >= 0 else 1
            else:
                end = at + less[piece] + 1 if piece >= 0 else at + 1
                if not failed[(end - base) >> 3] >> ((end - base) & 7) & 1:
                    fits = True if last is None else pairs.get((last, piece))
                    if fits is None:
                        fits = self.compatible(last, piece)
                    if fits:
                        laid.append(piece)
                        last, at = piece, end
                        if at < stop:
                            piece = longest[at] or single.get(text[at]) or -1 - ord(text[at])
                        continue
            # the next shorter candidate here; last the bare character
            if piece < 0:
                piece = None
            else:
                cut = shorter[piece]
                piece = -1 - ord(text[at]) if cut is None and less[piece] else cut
        return laid

    def _written(self, pieces: list[int]) -> list[int]:
        """Ids of pieces; characters that are no piece are written as bytes."""
        if min(pieces) >= 0:
            return pieces
        out: list[int] = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            elif (known := self.library.piece_to_id(chr(-1 - p))) != self.library.unk_id():
                out.append(known)
            else:
                out.extend(self.bytes[b] for b in chr(-1 - p).encode())
        return out

    def _forget(self) -> None:
        """Begin the runs' table anew. Row 0 is of no run and has no ids."""
        self.runs, self.words = _Rows(), {}  # rows of runs, and of whole words
        self.first, self.last, self.begin, self.size, self.blank = (array("i", [0]) for _ in range(5))
        self.ids = array("i")

    def _add(self, row: np.ndarray, ids: np.ndarray) -> None:
        """Rows (first and last piece, where the ids begin, their number, whether a blank comes first), and ids."""
        for column, values in zip((self.first, self.last, self.begin, self.size, self.blank, self.ids), (*row, ids)):
            column.frombytes(values.astype(np.int32).tobytes())

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for each pair of pieces; each distinct pair is looked up once."""
        pairs, of = np.unique((left.astype(np.int64) << 32) + right + PIECE, return_inverse=True)
        known, fits = self.pairs, []
        for pair in zip((pairs >> 32).tolist(), ((pairs & 0xFFFFFFFF) - PIECE).tolist()):
            fit = known.get(pair)
            fits.append(self.compatible(*pair) if fit is None else fit)
        return np.array(fits, bool)[of]

    def _learn(self, new: list[str]) -> None:
        """Rows for runs not seen before. The longest pieces from left to right are what
        backtracking tries first; where all of a run's are compatible, they are its
        pieces. The other runs are laid by backtracking."""
        joined = BORDER.join([r if BORDER not in r else "" for r in new])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        known, of = np.unique(chars, return_inverse=True)
        laid = np.array([self.single.get(chr(x), -1 - x) for x in known.tolist()], np.int64)[of]
        border = chars == ord(BORDER)
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(joined)), np.int64).reshape(-1, 2)
        ends, pieces = found[:, 0], found[:, 1]
        starts = ends - self.less[pieces]
        laid[starts] = pieces
        inner = np.zeros(len(chars) + 1, np.int8)  # after a piece's first character
        inner[starts + 1] += 1
        inner[ends + 1] -= 1
        shown = (np.cumsum(inner[:-1], dtype=np.int8) == 0) & ~border
        laid, run = laid[shown], np.cumsum(border)[shown]
        size = np.bincount(run, minlength=len(new))
        whole = (size > 0)
        whole[run[laid < 0]] = False
        near = np.flatnonzero(run[1:] == run[:-1])
        whole[run[near[~self._fits(laid[near], laid[near + 1])]]] = False
        held = whole[run]
        ids, size = laid[held], np.where(whole, size, 0)
        begin = np.cumsum(size) - size
        at = np.minimum(begin, max(len(ids) - 1, 0))
        first, last = (ids[at], ids[np.maximum(at + size - 1, 0)]) if len(ids) else (size.copy(), size.copy())
        rest = np.flatnonzero(~whole).tolist()
        plain = [new[i] for i in rest if BORDER not in new[i]]
        backtracked, more, total = iter(self.segment(plain)), [], len(ids)
        for i in rest:
            own = next(backtracked) if BORDER not in new[i] else self._alone(new[i])
            first[i], last[i] = own[0], own[-1]
            own = self._written(own)
            begin[i], size[i] = total, len(own)
            total += len(own)
            more.extend(own)
        blank = np.fromiter((r[0] == BLANK for r in new), bool, len(new))
        self._add(np.array([first, last, begin + len(self.ids), size, blank]), np.concatenate([ids, np.array(more, np.int64)]))

    def _rows(self, texts: list[list[str]]) -> np.ndarray:
        """The table's row of each run of all texts, one text after the other."""
        runs = self.runs
        runs.new, runs.rows = [], len(self.size)
        rows = np.fromiter(map(runs.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if runs.new:
            self._learn(runs.new)
        for r in runs.new:
            if len(r) > CACHED_LENGTH:
                del runs[r]
        return rows

    def _mend(self, rows: np.ndarray, texts: list[list[str]], bounds: np.ndarray) -> None:
        """Where the pieces at a border inside a word aren't compatible, the word's first
        run gets the row of the whole word, and its others get row 0."""
        inside = np.ones(len(rows) + 1, bool)  # whether a run goes on with the word before it
        inside[bounds] = False
        if self.by_words:
            inside[:-1] &= np.array(self.blank)[rows] == 0
        border = np.flatnonzero(inside)
        bad = border[~self._fits(np.array(self.last)[rows[border - 1]], np.array(self.first)[rows[border]])].tolist()
        runs, done = list(chain.from_iterable(texts)) if bad else [], 0
        for at in bad:
            if at < done:
                continue
            begin, done = at - 1, at + 1
            while inside[begin]:
                begin -= 1
            while inside[done]:
                done += 1
            word = "".join(runs[begin:done])
            row = self.words.get(word)
            if row is None:
                pieces = self._alone(word)
                ids, row = self._written(pieces), len(self.size)
                self._add(np.array([[pieces[0]], [pieces[-1]], [len(self.ids)], [len(ids)], [word[0] == BLANK]]), np.array(ids))
                if len(word) <= CACHED_LENGTH:
                    self.words[word] = row
            rows[begin:done] = 0
            rows[begin] = row

    def _alone(self, word: str) -> list[int]:
        """The pieces of one word, whatever characters it has."""
        longest = [0] * len(word)
        for end, piece in self.automaton.iter(word):
            longest[end - self.reach[piece]] = piece
        return self._lay(word, longest, 0, len(word))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text all its ids, the end id last, and their decimals joined by a blank.

        A word is put together from its runs of letters and of marks, if the pieces at
        each border are compatible; only runs not seen before are segmented.
        """
        parts = [_RUN.findall(self.library.normalize(t)) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in parts])]).astype(np.int64)
        rows = self._rows(parts)
        self._mend(rows, parts, bounds)
        lengths = np.array(self.size, np.int64)[rows]
        ends = np.cumsum(lengths)
        # where each id lies in the table: its run's begin there, less the ids before the run, plus its own place
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.array(self.begin)[rows] - (ends - lengths), lengths)
        ids = np.array(self.ids)[at]
        if len(self.runs) + len(self.words) > CACHED or len(self.ids) > 16 * CACHED:
            self._forget()
        stops = np.concatenate([[0], ends])[bounds].tolist()
        last = self.library.eos_id()
        for begin, stop in zip(stops, stops[1:]):
            own = ids[begin:stop]
            yield [*own.tolist(), last], self.decimals[own].tobytes().translate(None, b"\0").decode() + str(last)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    """One per worker process."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     with_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, ids, decoded_sha256, decoded``.

    Every whole text is encoded (null: empty, whose only id is the end id) and its
    ids decoded again. ``ids_sha256`` is of the decimal ids joined by one space.
    ``ids`` and ``decoded`` are null unless ``with_ids``. A null id stays null,
    repeated rows give a row each, an empty table an empty result; other columns
    are not read. A document's ids are held at once, so a task needs memory for its
    longest text.
    """
    ship(docs.sparkSession)
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and to trace them takes a third of the time
        c = codec(model)
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            for first, last in batches_of(texts, 2 << 20):
                rows = [[], [], [], [], []]
                for ids, decimals in c.encode([t or "" for t in texts.slice(first, last - first).to_pylist()]):
                    decoded = c.decode(ids)
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(decimals.encode()).hexdigest())
                    rows[2].append(ids if with_ids else None)
                    rows[3].append(hashlib.sha256(decoded.encode()).hexdigest())
                    rows[4].append(decoded if with_ids else None)
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, last - first), *[pa.array(x, t) for x, t in zip(rows, kinds)]],
                    names=["doc_id", "n_tokens", "ids_sha256", "ids", "decoded_sha256", "decoded"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, ids array<int>, "
                                  "decoded_sha256 string, decoded string")
