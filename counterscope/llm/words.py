"""Hashes of words and word shingles for whole Arrow batches of texts, by numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Words are hashed by a
polynomial over random byte values, so that one cumulative sum serves all words of a piece of text.
Pieces are cut between documents or words: memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 18
_LONG_WORD = 1 << 20
_U = np.uint64

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters, digits and the apostrophe, for words without punctuation.
NOT_LETTERS = np.arange(256) < 128
NOT_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(1, 2**64, 256, dtype=_U)[_LOWER]
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _random.integers(1, 2**64, 5, dtype=_U) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the step and of its inverse, grown when a longer piece comes."""

    up = _powers(_STEP, 2 * PIECE)
    down = _powers(_STEP_INVERSE, 2 * PIECE + 1)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_STEP, n), _powers(_STEP_INVERSE, n + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end with a document or at a separator."""
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + PIECE)
        if stop < end:
            ready = offsets[np.searchsorted(offsets, stop, "right") - 1]
            if ready > start:
                stop = int(ready)
            else:
                limit = int(offsets[np.searchsorted(offsets, stop, "left")])
                while stop < limit:
                    gap = np.flatnonzero(gaps[data[stop : stop + PIECE]][: limit - stop])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(limit, stop + PIECE)
        yield start, stop
        start = stop


class Words:
    """All words of a column: ``hashes``, the first and next byte of each (``first``, ``end``), and ``bounds``:
    text i has the words bounds[i] to bounds[i + 1]. ``data`` and ``offsets`` are the texts' bytes.

    ``starts[m]`` has hashes of the first m bytes of each word, 0 where it has no more than m.
    """

    def __init__(self, column: pa.Array, gaps: np.ndarray = SPACES, starts: Sequence[int] = ()):
        self.data, self.offsets = text_bytes(column)
        parts = [self._piece(lo, hi, gaps, starts) for lo, hi in _cuts(self.data, self.offsets, gaps)]
        joined = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.hashes, self.first, self.end = joined[:3]
        self.starts = dict(zip(starts, joined[3:])) if parts else {m: np.zeros(0, _U) for m in starts}
        self.bounds = np.searchsorted(self.first, self.offsets)

    def _piece(self, lo: int, hi: int, gaps: np.ndarray, starts: Sequence[int]) -> list[np.ndarray]:
        piece, offsets = self.data[lo:hi], self.offsets
        inside = ~gaps[piece]
        fresh = np.zeros(hi - lo + 1, dtype=bool)
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        fresh[edges - lo] = True
        fresh[0] = fresh[-1] = True
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | fresh[1:-1]
        last[:-1] &= ~inside[1:] | fresh[1:-1]
        first, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        if hi - lo > 2 * _LONG_WORD:
            return self._long(piece, first, end, lo, starts)
        _Powers.reach(hi - lo)
        total = np.zeros(hi - lo + 1, dtype=_U)
        np.cumsum(_BYTE[piece] * _Powers.up[: hi - lo], out=total[1:])
        down = _Powers.down[first]
        value = mixed((total[end] - total[first]) * down)
        for i in np.flatnonzero(end - first > _LONG_WORD):
            value[i] = _long_hash(piece[first[i] : end[i]])
        more = []
        for m in starts:
            cut = np.minimum(first + m, hi - lo)
            more.append(np.where(end - first > m, mixed((total[cut] - total[first]) * down), _U(0)))
        return [value, first + lo, end + lo, *more]

    @staticmethod
    def _long(piece, first, end, lo, starts) -> list[np.ndarray]:
        """A piece with a word beyond _LONG_WORD bytes: such words are hashed whole, the others one by one."""

        def one(run: np.ndarray) -> int:
            return int(mixed(np.sum(_BYTE[run] * _Powers.up[: len(run)], keepdims=True))[0])

        _Powers.reach(_LONG_WORD)
        runs = [piece[a:b] for a, b in zip(first, end)]
        value = [_long_hash(x) if len(x) > _LONG_WORD else one(x) for x in runs]
        more = [np.array([one(x[:m]) if len(x) > m else 0 for x in runs], dtype=_U) for m in starts]
        return [np.array(value, dtype=_U), first + lo, end + lo, *more]


def _long_hash(run: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(_LOWER[run].tobytes())


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and where each text's words begin in them."""
    words = Words(column)
    return words.hashes, words.bounds


def hash_of(word: str) -> int:
    """The hash of a single word, as ``Words`` gives it."""
    return int(Words(pa.array([word]), np.zeros(256, dtype=bool)).hashes[0])


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of every text's shingles of ``width`` (up to 5) words.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), dtype=_U)
        for i in range(width):
            rolled += words[i : i + max(n, 0)] * _PLACE[i]
        rolled = mixed(rolled)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                values = np.sort(rolled[lo : hi - width + 1])
                keep = np.empty(len(values), dtype=bool)
                keep[0] = True
                np.not_equal(values[1:], values[:-1], out=keep[1:])
                yield values[keep]
            elif hi > lo:
                short = np.sum(words[lo:hi] * _PLACE[: hi - lo], keepdims=True)
                yield mixed(short + _U(hi - lo))
            else:
                yield np.zeros(0, dtype=_U)
