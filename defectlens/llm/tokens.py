"""Token ids of whole texts in Arrow batches.

Byte-pair merges never cross the tokenizer's own word boundaries, so a text
may be cut where such a boundary is certain and equal pieces encoded once:

* ``"space"`` (byte-level vocabularies): before a single space between two
  characters that are not white space; a text with any other space is encoded
  whole;
* ``"blank"`` (vocabularies that drop white space): at every space and line
  feed.

Pieces made of plain letters and marks are whole words of both kinds of
vocabulary (a run of letters or of marks, with the space before it), so they
go to the library's merges without its search for words; any other piece goes
through the whole tokenizer.

The memo of pieces is thinned (pieces seen once go) when it holds
``MEMO_PIECES`` pieces or ``MEMO_CHARS`` characters, and that of words begins
anew at ``MEMO_WORDS`` words or ``MEMO_CHARS`` ids; that bounds memory and
changes no result.
"""

from __future__ import annotations

import ctypes
import os
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose word boundaries need no tables, and ASCII marks but the apostrophe.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = rf" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n"
#: Marks of this module (texts that hold one are encoded whole): between words sent to the merges, between pieces, before a text's first piece.
_CUT, _STOP, _FIRST = "\x00", "\x01", "\x02"

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018 - other C libraries have none
except (OSError, AttributeError):
    _LIBC = None

MEMO_PIECES = 300_000
MEMO_WORDS = 1_000_000
MEMO_CHARS = 12_000_000


def _give_back() -> None:
    """Return what earlier batches have freed to the system; a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class PieceEncoder:
    """ids of texts by the tokenizers library, encoding each distinct piece once."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = cut
        self._tokens = re.compile(f"{_PLAIN}|{_STOP}|[^{_STOP}]", re.S)
        self._plain = re.compile(_PLAIN)
        self._merges_only()
        self._forget_words()
        self._forget()

    def _merges_only(self) -> None:
        """The same merges without the search for words: words come cut and in byte letters."""
        from tokenizers import Tokenizer, pre_tokenizers

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        self.letter = np.zeros(256, np.uint32)
        hidden = [b for b in range(256) if b not in shown]
        self.letter[shown], self.letter[hidden] = shown, 256 + np.arange(len(hidden))
        cut = chr(int(self.letter[0]))
        self.merges = Tokenizer(self.library.model)
        model = self.merges.model
        # where nothing merges with the mark it may stay at its word's end, which halves the calls of the merges
        alone = (not (model.end_of_word_suffix or model.continuing_subword_prefix or model.ignore_merges)
                 and not any(cut in t and t != cut for t in self.library.get_vocab()))
        self.merges.pre_tokenizer = pre_tokenizers.Split(cut, "merged_with_previous" if alone else "isolated")
        self.cut_id = self.merges.encode(cut, add_special_tokens=False).ids[0]

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that are whole units of the tokenizer, and their offsets."""
        if self.cut == "blank":
            words = [w.lower() for w in words]
        parts = [np.zeros(0, np.uint32)]
        for a in range(0, len(words), 5_000):  # the library's results are large; few at a time
            texts = []
            for k in range(a, min(a + 5_000, len(words)), 500):
                raw = np.frombuffer((_CUT.join(words[k:k + 500]) + _CUT).encode(), np.uint8)
                texts.append(self.letter[raw].tobytes().decode("utf-32-le"))
            parts += [np.array(x.ids, np.uint32) for x in self.merges.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(parts)
        ends = np.flatnonzero(flat == self.cut_id)
        return np.delete(flat, ends), np.concatenate([[0], ends - np.arange(len(ends))])

    @property
    def dtype(self) -> str:
        return "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def _forget_words(self) -> None:
        self.words = pa.array([], pa.string())
        self.word_first = np.zeros(0, np.int64)
        self.word_size = np.zeros(0, np.int64)
        self.word_flat = np.zeros(0, np.uint32)

    def _word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of distinct plain words in their own memo: pieces differ by a mark more often than by their words."""
        if len(self.words) > MEMO_WORDS or len(self.word_flat) > MEMO_CHARS:
            self._forget_words()
        names = pa.array(words, pa.string())
        rows = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            rows[missing] = len(self.words) + np.arange(len(missing))
            ids, ends = self._word_ids([words[k] for k in missing.tolist()])
            self.words = pa.concat_arrays([self.words, names.take(pa.array(missing))])
            self.word_first = np.concatenate([self.word_first, ends[:-1] + len(self.word_flat)])
            self.word_size = np.concatenate([self.word_size, np.diff(ends)])
            self.word_flat = np.concatenate([self.word_flat, ids])
        return rows

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())  # the known pieces, by row
        self.size = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int64)

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _full(self, pieces: list[str]) -> list[str]:
        """The pieces as they stand in the text, with the space before them."""
        return pieces if self.cut == "blank" else [p[1:] if p[:1] == _FIRST else " " + p for p in pieces]

    def _sound(self, piece: str) -> bool:
        """Whether the cuts at both ends of this piece are certain boundaries."""
        if self.cut == "blank" or not piece:
            return True
        body = piece if piece[0] != " " else piece[1:]
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _learn(self, new: list[str]) -> None:
        """Pieces of plain words only go straight to the merges, the others to the library."""
        names, new = new, self._full(new)
        tokens = self._tokens.findall(_STOP.join(new))
        unique = list(dict.fromkeys(tokens))
        at = {t: k for k, t in enumerate(unique)}
        row = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
        # whatever is not plain was found character by character
        plain = np.fromiter(map(len, unique), np.int64, len(unique)) > 1
        for k in np.flatnonzero(~plain).tolist():
            plain[k] = self._plain.fullmatch(unique[k]) is not None
        # a line feed is a word of its own only right before letters or marks
        initial = np.fromiter(map(ord, map(itemgetter(0), unique)), np.int64, len(unique))
        follows = np.append(plain & (initial != 32) & (initial != 10), False)
        lone = (row == at.get("\n", -1)) & ~follows[np.append(row[1:], len(unique))]
        stop = row == at.get(_STOP, -1)
        piece = np.cumsum(stop)[~stop]
        row, lone = row[~stop], lone[~stop]
        odd = np.zeros(len(new), bool)
        odd[piece[~plain[row] | lone]] = True
        words = np.flatnonzero(plain)
        at_word = self._word_rows([unique[k] for k in words.tolist()])
        first, size = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        first[words], size[words] = self.word_first[at_word], self.word_size[at_word]
        row = row[~odd[piece]]
        sizes = np.bincount(piece[~odd[piece]], size[row], len(new)).astype(np.int64)
        take = size[row]
        flat = self.word_flat[np.repeat(first[row] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))]
        place = np.cumsum(sizes) - sizes
        if odd.any():
            others = np.flatnonzero(odd).tolist()
            ids = self._library_ids([new[k] for k in others])
            place[others] = len(flat) + np.cumsum([0, *map(len, ids)])[:-1]
            sizes[others] = [len(x) if self._sound(new[k]) else -1 for k, x in zip(others, ids)]
            flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.uint32)])
        self.names = pa.concat_arrays([self.names, pa.array(names, pa.string())])
        self.size, self.first, self.flat, self.seen = (np.concatenate(x) for x in (
            (self.size, sizes), (self.first, place + len(self.flat)), (self.flat, flat), (self.seen, np.zeros(len(new), np.int64))))

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Row of each piece in the memo; unknown ones are encoded first."""
        coded = pieces.dictionary_encode()
        unique = coded.dictionary
        rows = pc.fill_null(pc.index_in(unique, value_set=self.names), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            rows[missing] = len(self.names) + np.arange(len(missing))
            self._learn(unique.take(pa.array(missing)).to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        return rows[coded.indices.to_numpy()]

    def _all_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row of every piece of the texts, and the texts' offsets in them.

        Each distinct piece of the batch is looked up once.
        """
        if self.cut == "blank":
            texts = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        names = coded.dictionary
        if self.cut == "blank":
            rows = self._rows(names)[codes]
        else:  # a text's first piece has no space before it
            begin = ends[:-1]
            firsts = pc.binary_join_element_wise(_FIRST, names.take(pa.array(codes[begin])), "")
            found = self._rows(pa.concat_arrays([names, firsts]))
            rows = found[codes]
            rows[begin] = found[len(names):]
        self.seen += np.bincount(rows, minlength=len(self.seen))
        return rows, ends

    def _thin(self) -> None:
        """Keep the pieces seen more than once since the last time, if they are few enough."""
        keep = np.flatnonzero(self.seen > 1)
        names = self.names.take(pa.array(keep))
        if len(keep) > MEMO_PIECES * 3 // 4 or len(names) and pc.sum(pc.binary_length(names)).as_py() > MEMO_CHARS:
            return self._forget()
        self.names = names
        size = self.size[keep]
        step = np.maximum(size, 0)
        first = np.cumsum(step) - step
        self.flat = self.flat[np.repeat(self.first[keep] - first, step) + np.arange(int(step.sum()))]
        self.size, self.first, self.seen = size, first, np.zeros(len(keep), np.int64)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them."""
        _give_back()
        if len(self.names) > MEMO_PIECES or len(self.names) and pc.sum(pc.binary_length(self.names)).as_py() > MEMO_CHARS:
            self._thin()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        marked = np.zeros(len(texts), bool)
        for mark in (_CUT, _STOP, _FIRST):
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        rows, ends = self._all_rows(pc.if_else(pa.array(marked), "", texts) if marked.any() else texts)
        size = self.size[rows]
        doubt = np.flatnonzero(size < 0)
        marked[np.searchsorted(ends, doubt, side="right") - 1] = True
        whole = np.flatnonzero(marked).tolist()
        for k in whole:
            size[ends[k]:ends[k + 1]] = 0
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        take = np.repeat(self.first[rows] - total[:-1], size) + np.arange(total[-1])
        ids, offsets = self.flat[take], total[ends]
        if whole:
            parts, n = [], 0
            sizes = np.diff(offsets)
            for k, x in zip(whole, self._library_ids([texts[k].as_py() for k in whole])):
                parts += [ids[n:offsets[k]], np.array(x, np.uint32)]
                n, sizes[k] = offsets[k], len(x)
            ids = np.concatenate([*parts, ids[n:]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        return ids, offsets


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, cut: str) -> PieceEncoder:
    """One encoder a Python worker."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = PieceEncoder(path, cut)
    return _ENCODERS[path, cut]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
