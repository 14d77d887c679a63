"""Whole batches of texts as numpy arrays of word and byte hashes.

Works on an Arrow string column's own buffer: no Python string per word is made. A batch is
taken in chunks of whole texts, so memory is bounded by the chunk size or the longest text.
Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from ctypes import CDLL
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def tidy(f):
    """For generators that are a worker's task: give freed memory back at the end, as workers are reused."""

    @wraps(f)
    def g(*args, **kw):
        try:
            yield from f(*args, **kw)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                CDLL("libc.so.6").malloc_trim(0)

    return g


_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE, _FIVE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)

_fold = np.arange(256)
_fold[65:91] += 32
_word = np.zeros(256, bool)
_word[48:58] = _word[97:123] = _word[128:] = True
#: Hash of each byte as part of a word, 0 for bytes between words.
WORD_BYTE = np.where(_word[_fold], _BYTE[_fold], U64(0))
IS_WORD = _word[_fold]
#: The same for words that are whatever stands between blanks, with case.
NOT_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PLAIN_BYTE = np.where(NOT_SPACE, _BYTE, U64(0))
FOLDED_BYTE = np.where(NOT_SPACE, _BYTE[_fold], U64(0))
_ASCII = np.arange(256) < 128
ALNUM = _ASCII & _word[_fold]
#: Printing ASCII characters but letters, digits and the apostrophe.
PUNCT = _ASCII & ~ALNUM & (np.arange(256) > 32) & (np.arange(256) != 39) & (np.arange(256) != 127)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, U64)
        p[:1] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (a splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "left")) + 1
        yield lo, min(hi, len(texts))
        lo = hi


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts in them (null: empty)."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def count_words(texts: pa.Array) -> np.ndarray:
    """The number of words of each text, without their hashes."""
    data, offsets = raw(texts)
    starts = IS_WORD[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    inside = starts[first]
    starts[1:] &= ~starts[:-1]
    starts[first] = inside
    upto = np.append(0, np.cumsum(starts))
    return upto[offsets[1:]] - upto[offsets[:-1]]


class Words:
    """Word hashes of a chunk of texts: ``hash``, byte ranges, and the words of text i at ``at[i]:at[i+1]``."""

    def __init__(self, texts: pa.Array, inside_byte: np.ndarray = IS_WORD, byte_hash: np.ndarray = WORD_BYTE, sides: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.offsets = raw(texts)
        data, n = self.data, len(self.data)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = inside_byte[data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        if sides and n:  # words also end where bytes of the two kinds meet
            a, b = sides[0][data], sides[1][data]
            meet = (a[:-1] & b[1:]) | (b[:-1] & a[1:])
            starts[1:] |= meet
            ends[:-1] |= meet
        # a text's first and last bytes border on another text
        lo = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        hi = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        starts[lo] |= inside[1:-1][lo]
        ends[hi] |= inside[1:-1][hi]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if n:
            p, q = powers(1 << max(19, int(n).bit_length()))
            run = np.zeros(n + 1, U64)
            np.cumsum(byte_hash[data] * p[:n], out=run[1:])
            self.hash = mix((run[self.end] - run[self.start]) * q[self.start])
        else:
            self.hash = np.zeros(0, U64)
        self.at = np.searchsorted(self.start, self.offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside one text, and each text's range in them.

        A text of fewer words, but not none, has one gram: all its words.
        """
        n, counts = len(self.hash), np.diff(self.at)
        total = np.zeros(max(0, n - k + 1), U64)
        for j in range(k):
            total = total * _FIVE + self.hash[j : j + len(total)]
        own = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
        bounds = np.concatenate([[0], np.cumsum(own)])
        out = np.empty(int(bounds[-1]), U64)
        keep = np.zeros(n + 1, np.int64)
        full = counts >= k
        np.add.at(keep, self.at[:-1][full], 1)
        np.add.at(keep, self.at[:-1][full] + own[full], -1)
        place = np.repeat(full, own)
        out[place] = mix(total[np.flatnonzero(np.cumsum(keep)[: len(total)])])
        for i in np.flatnonzero(~full & (counts > 0)):
            h = U64(0)
            for w in self.hash[self.at[i] : self.at[i + 1]]:
                h = U64((int(h) * int(_FIVE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out[bounds[i]] = mix(np.array([h ^ U64(int(counts[i]))], U64))[0]
        return out, bounds
