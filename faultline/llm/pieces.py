"""Pieces of a public tokenizer, looked up once per distinct unit of text.

A unit is a stretch of text that the tokenizer never joins with its neighbours, so its pieces don't depend on where it stands.  Units are told
apart by a 64-bit hash; a worker keeps the pieces of the units it has met, up to a number of units, and starts anew when that is reached.
"""

from __future__ import annotations

import os

import numpy as np

from faultline.llm.words import NOT_SPACE, bounds, span_hashes

KEPT_UNITS = 800_000
#: Bytes of texts that are looked up together.
LOOKUP_BYTES = 2 << 20

_SAFE_ASCII = np.zeros(256, bool)
_SAFE_ASCII[0x21:0x7F] = True
_SAFE_LEAD = _SAFE_ASCII.copy()
_SAFE_LEAD[0xC3:0xE0] = True  # two-byte characters from U+00C0 on: none of them is white space
_TWO_BYTE_LEAD = np.zeros(256, bool)
_TWO_BYTE_LEAD[0xC3:0xE0] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


def spaced_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts for a byte-level pre-tokenizer: before a single space, and around a single line feed, between characters surely not white space.

    Such a place always ends a pre-token: a space goes with what follows it, a line feed stands alone.  Doubtful places are not cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 2:
        before = _SAFE_ASCII[data]
        before[1:] |= _TAIL[data[1:]] & _TWO_BYTE_LEAD[data[:-1]]
        row_edge = cut.copy()
        inner = np.flatnonzero(((data == 0x20) | (data == 0x0A))[1:-1]) + 1
        inner = inner[before[inner - 1] & _SAFE_LEAD[data[inner + 1]] & ~row_edge[inner] & ~row_edge[inner + 1]]
        cut[inner] = True
        cut[inner[data[inner] == 0x0A] + 1] = True
    edges = np.flatnonzero(cut)
    return edges[:-1], edges[1:]


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts for a pre-tokenizer that drops white space: the runs between ASCII white space."""
    return bounds(data, offsets, NOT_SPACE)


class Pieces:
    """Pieces per distinct unit: their number, and their ids if asked for."""

    def __init__(self, path: str, ids: bool, limit: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.with_ids, self.limit = Tokenizer.from_file(path), ids, limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of every unit's entry."""
        keys, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > self.limit and len(self.keys):
                self.clear()
                known[:] = False
            self._add(data, starts, ends, keys[~known], where[~known])
            at = np.searchsorted(self.keys, keys)
        return at[inverse]

    def _add(self, data, starts, ends, keys, where) -> None:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[where].tolist(), ends[where].tolist())]
        counts, ids = np.empty(len(texts), np.int64), []
        for i in range(0, len(texts), 20_000):
            found = self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)
            if self.with_ids:
                found = [x.ids for x in found]
                ids += [np.fromiter((y for x in found for y in x), np.uint32)]
            counts[i : i + len(found)] = [len(x) for x in found]
        first = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = all_keys[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.first = np.concatenate([self.first, first])[order]


_kept: dict[tuple, Pieces] = {}


def pieces_of(path: str, ids: bool) -> Pieces:
    """This worker's pieces for a tokenizer file."""
    if (path, ids) not in _kept:
        _kept[path, ids] = Pieces(path, ids)
    return _kept[path, ids]
