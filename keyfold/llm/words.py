"""Words of whole texts, and their token ids, worked on a batch at a time.

A word here is a stretch of text that a byte-pair tokenizer treats alone: it
starts at a white-space byte that follows a character which surely is none, or
at one of ``. , ; : ! ?`` after an ASCII letter. No pattern of the tokenizers
used here matches across such a place (letter runs end there, and a run of
white space starts there), so the ids of a text are the ids of its words in a
row. Where a character might be white space outside ASCII no word starts and
the word is simply longer; strings of special tokens are never cut.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b".,;:!?")] = True
DARK = np.zeros(256, dtype=bool)  # ASCII that is neither white space nor control
DARK[33:127] = True
LEAD2 = np.zeros(256, dtype=bool)  # first bytes of two-byte characters, without those that hold white space
LEAD2[0xC3:0xE0] = True


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in a row (as binary), and for each row the number of its first word, plus the total."""
    text = text.cast(pa.large_binary())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    if not n or offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    start = np.zeros(len(data) + 1, dtype=bool)
    before = data[:-1]
    dark = DARK[before]
    dark[1:] |= (before[1:] >= 0x80) & LEAD2[before[:-1]]
    start[1:-1] = (SPACE[data[1:]] & dark) | (PUNCTUATION[data[1:]] & LETTER[before])
    start[offsets] = True
    start[-1] = False
    at = np.flatnonzero(start).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
    return words, np.searchsorted(at, offsets)


def bytes_of(column: pa.Array, starts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The joined values of a large binary column, and where the groups that begin at ``starts`` begin in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return memoryview(column.buffers()[2] or b"") if len(column) else memoryview(b""), offsets[starts]


def grouped(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """Join the values of each group into one value."""
    data, at = bytes_of(column, starts)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


_kept: dict[tuple, Encoder] = {}


def encoder(path: str, limit: int, version: str = "", words: pa.Array | None = None, ids: pa.Array | None = None) -> Encoder:
    """One encoder for each Python worker and ``version``, whose table later tasks find warm."""
    key = (path, limit, version)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(path, limit, words, ids)
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)
                pa.default_memory_pool().release_unused()


class Encoder:
    """Token ids of words: a table of known words, and the library for each distinct word that is not in it.

    ``limit`` bounds the table, to which new words are added in the order met.
    """

    def __init__(self, path: str, limit: int = 1 << 20, words: pa.Array | None = None, ids: pa.Array | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.marks_end = any(w.endswith("</w>") for w in vocabulary)
        self.mark = np.zeros(max(vocabulary.values(), default=0) + 1 + 256, dtype=bool)
        self.mark[[i for w, i in vocabulary.items() if (w.endswith("</w>") if self.marks_end else w[0] == "\u0120")]] = True
        self.limit = limit
        self.words = pa.array([], pa.large_binary()) if words is None else words
        self.ids = pa.array([], pa.large_binary()) if ids is None else ids

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and tokens of words, one call for each word."""
        counts, flat = [], []
        for k in range(0, len(words), 10_000):
            found = [e.ids for e in self.library.encode_batch_fast(words[k : k + 10_000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(counts[-1].sum())))
        return np.concatenate([*counts, np.zeros(0, np.int64)]), np.concatenate([*flat, np.zeros(0, "<u4")])

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As above for words of ASCII letters after a space: many in one call, told apart by the tokens that mark where words start or end."""
        counts, flat = [], []
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            texts = ["".join(part[i : i + 1000]) for i in range(0, len(part), 1000)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)), dtype="<u4")
            if self.marks_end:
                n = np.diff(np.flatnonzero(self.mark[ids]), prepend=-1)
            else:
                n = np.diff(np.flatnonzero(self.mark[ids]), append=len(ids))
            if len(n) != len(part):
                n, ids = self._each(part)
            counts.append(n)
            flat.append(ids)
        return np.concatenate([*counts, np.zeros(0, np.int64)]), np.concatenate([*flat, np.zeros(0, "<u4")])

    def library_ids(self, words: pa.Array) -> pa.Array:
        """Ids as little-endian unsigned 32-bit integers, for each word."""
        names = words.cast(pa.large_string()).to_pylist()
        plain = np.fromiter((w[:1] == " " and w.isascii() and w[1:].isalpha() for w in names), dtype=bool, count=len(names))
        n1, f1 = self._joined([w for w, p in zip(names, plain) if p])
        n2, f2 = self._each([w for w, p in zip(names, plain) if not p])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([n1, n2]) * 4)]).astype(np.int64)
        both = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([f1, f2]))])
        place = np.empty(len(names), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(names))
        return both.take(pa.array(place))

    def encode(self, words: pa.Array) -> pa.Array:
        distinct = words.dictionary_encode()
        names = distinct.dictionary
        at = pc.index_in(names, value_set=self.words)
        new = names.filter(pc.is_null(at))
        at = at.to_numpy(zero_copy_only=False)
        ids = self.ids
        if len(new):
            new_ids = self.library_ids(new)
            at = at.astype(np.float64)
            at[np.isnan(at)] = len(ids) + np.arange(len(new))
            ids = pa.concat_arrays([ids, new_ids])
            if room := min(len(new), self.limit - len(self.words)):
                self.words = pa.concat_arrays([self.words, new[:room]])
                self.ids = pa.concat_arrays([self.ids, new_ids[:room]])
        at = at.astype(np.int64)
        return ids.take(pa.array(at[distinct.indices.to_numpy()]))
