"""Words of whole Arrow text columns at once, as numpy arrays of hashes: no Python object per text or word.

A word is a run of letters and digits. ASCII and Latin-1 letters compare without case; letters of other scripts compare
as they are. A hyphen at a line's end is taken as hyphenation and the word goes on in the next line. Punctuation of the
Latin-1 and General Punctuation blocks parts words, as do all other ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is one piece of its own.
CHUNK = 4 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


class Words:
    """hash, start and end (byte offsets in ``data``) of each word, and first[i]:first[i + 1], the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        global _POWERS
        keep = None
        if len(data) > 2:
            brk = (data[:-1] == 45) & (data[1:] == 10)
            brk[1:] &= _WORD[data[:-2]]
            brk[0] = False
            if brk.any():
                keep = np.ones(len(data), dtype=bool)
                at = np.flatnonzero(brk)
                keep[at] = keep[at + 1] = False
                moved = np.concatenate([[0], np.cumsum(keep)])
                offsets = moved[offsets]
                data = data[keep]
        self.data, self.offsets = data, offsets
        word = _WORD[data]
        high = np.flatnonzero(data >= 0xC2)
        low = data.copy()
        if len(high):
            nxt = data[np.minimum(high + 1, len(data) - 1)]
            two = high[data[high] == 0xC2]
            three = high[(data[high] == 0xE2) & (nxt == 0x80)]
            for at, n in ((two, 2), (three, 3)):
                for k in range(n):
                    word[np.minimum(at + k, len(data) - 1)] = False
            upper = high[(data[high] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]
            low[upper + 1] += 32
        low = _LOWER[low] if not len(high) else np.where(low < 128, _LOWER[low], low)
        edge = np.empty(len(data) + 1, dtype=bool)
        if len(data):
            edge[0], edge[-1] = word[0], word[-1]
            edge[1:-1] = word[1:] != word[:-1]
            cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])  # words don't go on from one text to the next
            both = cuts[word[cuts] & word[cuts - 1]]
        else:
            edge[:] = False
            both = np.empty(0, dtype=np.int64)
        marks = np.flatnonzero(edge)
        if len(both):
            marks = np.sort(np.concatenate([marks, both, both]))
        self.start, self.end = marks[0::2], marks[1::2]
        n = self.end - self.start
        if len(n) and n.max() > len(_POWERS):
            _POWERS = _powers(int(n.max()) * 2)
        if len(n):
            total = int(n.sum())
            first = np.cumsum(n) - n
            place = np.arange(total) - np.repeat(first, n)
            h = (low[word].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
            h = np.add.reduceat(h, first)
            h ^= h >> np.uint64(32)
            h *= _M
            h ^= h >> np.uint64(29)
        else:
            h = np.empty(0, dtype=np.uint64)
        self.hash = h
        self.first = np.searchsorted(self.start, offsets)

    def text(self, i: int, j: int) -> str:
        """The text from word i to word j, j included."""
        return self.data[self.start[i] : self.end[j]].tobytes().decode("utf-8", "replace")


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    array = array.fill_null("").cast(pa.large_string())
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def pieces(array: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of texts i..j-1) over the whole column, in pieces of about CHUNK bytes; texts are never cut."""
    if not len(array):
        return
    raw, offsets = column(array)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words_of(texts: list[str | None]) -> Words:
    """The words of a few texts (tests, queries)."""
    return Words(*column(pa.array(texts, type=pa.string())))


def hash_of(word: str) -> int:
    return int(words_of([word]).hash[0])
