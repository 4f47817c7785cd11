"""Words of whole Arrow batches at once: bounds, 64-bit hashes and shingles, with numpy on the UTF-8 bytes.

A hash stands for a word or a run of words.  Two different ones share a 64-bit value with a chance of about 1 in 10^19 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from faultline.llm.common import row_slices

BLOCK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes of words by the two definitions in use, after A-Z became a-z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        size = max(BLOCK_BYTES, n) + 2
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of bytes; spans are ascending and apart.

    Sums of byte values times powers of an odd base, shifted back to the span's start, then mixed.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        stop = max(i + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        high = int(ends[stop - 1])
        up, down = _power_tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:stop] - low, ends[i:stop] - low
        out[i:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = stop
    return out


@dataclass
class Block:
    """Some whole rows of a batch and their words."""

    first: int  # of the block's rows, in the batch
    data: np.ndarray  # the bytes of all rows
    offsets: np.ndarray  # of the rows in data, one more than rows
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    words: np.ndarray  # index of each row's first word, one more than rows

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.words)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def text_bytes(column: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of some rows of a string column; null is empty."""
    part = pc.fill_null(column.slice(start, stop - start), "").cast(pa.large_string())
    _, offsets, data = part.buffers()
    offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``; no run crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    end[:-1] = word[:-1] & (~word[1:] | edge[1:-1])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def blocks(column: pa.Array, inside: np.ndarray = NOT_SPACE, fold: bool = True, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The words of a string column, in blocks of whole rows of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for start, stop in row_slices(sizes, limit):
        data, offsets = text_bytes(column, start, stop)
        if fold:
            data = _FOLD[data]
        starts, ends = bounds(data, offsets, inside)
        yield Block(start, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, as if all words were one text; the last k - 1 entries are missing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j]
    return mix(total)


def shingles(hashes: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their row; a row of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(words)
    full = runs(hashes, k)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - np.repeat(words[:-1], counts)
    whole = np.flatnonzero(place + k <= np.repeat(counts, counts))
    out, rows = [full[whole]], [row[whole]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            at = words[:-1][short]
            total = np.full(len(short), np.uint64(m), np.uint64)
            for j in range(m):
                total += hashes[at + j] * _PLACE[j]
            out.append(mix(total))
            rows.append(short)
    return np.concatenate(out), np.concatenate(rows)
