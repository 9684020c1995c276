"""Words of a batch of texts as byte ranges, and hashes of ranges, all in numpy.

The operators that look at every word window of a corpus work on Arrow's own
buffers: a batch of texts becomes one byte array in which words stand behind one
another with one space between, and each word is a (start, end) pair. No Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Texts are taken together up to this many bytes, so that memory is bounded by
#: it or by the longest single text.
CHUNK_BYTES = 1 << 20


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of pieces of a text column, of ``rows`` rows at most; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n, row + rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of rows: ``text`` holds each word and one space after it.

    ``start``/``end`` are the words' ranges in ``text``, ``first`` the index of
    each row's first word, with the total behind the last.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        rows = len(offsets) - 1
        if lower:
            data = LOWER[data]
        data = np.insert(data, offsets[1:], 0x20)  # a space behind each row, so that every word has one separator behind it
        kept = ~SPACE[data]
        edge = np.flatnonzero(np.diff(kept, prepend=False))
        begin, behind = edge[::2], edge[1::2]
        kept[behind] = True
        text = data[kept]
        sizes = behind - begin + 1
        after = np.cumsum(sizes)
        text[after - 1] = 0x20
        self.text = np.append(text, np.full(8, 0x20, np.uint8))  # eight more, so that eight bytes can be read anywhere
        self.start, self.end = after - sizes, after - 1
        self.first = np.searchsorted(begin, offsets + np.arange(rows + 1))
        self.count = len(begin)
        self.rows = rows

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, row) of every run of ``n`` words that lies in one row."""
        if self.count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = self.row_of()
        first = np.flatnonzero(row[: self.count - n + 1] == row[n - 1 :])
        return first, row[first]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any byte ranges of one array, each in constant time: a polynomial's prefix sums."""

    def __init__(self, text: np.ndarray):
        power, self.inverse = _power_tables(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


# The primes of XXH64.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range of ``text``, which must go on for eight bytes behind the last.

    Ranges under 32 bytes, as nearly all runs of three words are, go through
    numpy by length; longer ones through the xxhash library.
    """
    out = np.zeros(len(start), np.uint64)
    lengths = end - start
    by_length = np.argsort(np.minimum(lengths, 32).astype(np.int16), kind="stable")
    bounds = np.searchsorted(np.minimum(lengths, 32)[by_length], np.arange(34))
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    four = np.ndarray((len(text) - 3,), "<u4", text, strides=(1,))
    with np.errstate(over="ignore"):
        for n in range(32):
            which = by_length[bounds[n] : bounds[n + 1]]
            if not len(which):
                continue
            at = start[which]
            h = np.full(len(which), np.uint64(seed) + _P5 + np.uint64(n), np.uint64)
            for _ in range(n // 8):
                h = _rotated(h ^ (_rotated(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
                at = at + 8
            if n % 8 >= 4:
                h = _rotated(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at = at + 4
            for _ in range(n % 4):
                h = _rotated(h ^ (text[at].astype(np.uint64) * _P5), 11) * _P1
                at = at + 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[which] = h ^ (h >> np.uint64(32))
    for i in by_length[bounds[32] :]:
        out[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]].tobytes(), seed)
    return out
