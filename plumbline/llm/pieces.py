"""Cut texts into the pieces of a byte-level pre-tokenizer with numpy, and encode every distinct piece once.

The pattern is the public one of byte-level BPE: contractions, letters, numbers and other signs with one leading blank, white
space. A piece's ids depend on the piece alone, so a task keeps the ids of the pieces it has met (a bounded cache that is
emptied when full) and only new ones reach the encoder; the ids of a text are put together by position.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from .arrays import expand, mix

SLICE_BYTES = 3 << 20
CACHE_PIECES = 1_500_000
# fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = range(4)
_U = np.uint64
_TABLES: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and a random 64-bit value for it."""
    if not _TABLES:
        kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(c))[0]
            if major in "LN":
                kind[c] = LETTER if major == "L" else NUMBER
        kind[WHITE_SPACE] = SPACE
        _TABLES["value"] = mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64)) | _U(1)
        _TABLES["kind"] = kind
    return _TABLES["kind"], _TABLES["value"]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of a slice, its code points, and the rows' offsets in code points."""
    text = data.tobytes().decode("utf-8", "surrogatepass")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(data):
        return text, cps, offsets
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return text, cps, heads[offsets]


def cuts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pieces, in code points; a row's pieces cover it without gaps."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = tables()[0][cps]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= row_start[:n]
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    k = kind[start]
    space = k == SPACE
    followed = space & ~row_start[end]
    cut = np.zeros(n + 1, bool)
    cut[start] = True
    last = end[followed] - 1
    cut[last] = True  # the last white space before a word stands alone or, as a blank, begins the word's piece
    blank = last[cps[last] == 32]
    cut[blank + 1] = False
    alone = start[(k == OTHER) & (end - start == 1)]
    p = alone[(cps[alone] == 39) & cut[alone] & ~row_start[alone + 1]]
    if len(p):
        nxt = np.append(cps, [0, 0]).astype(np.int64)
        a, b = nxt[p + 1], nxt[p + 2]
        b = np.where(row_start[np.minimum(p + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        short, long = p[one] + 1, p[two] + 1
        cut[short] = cut[long] = False
        cut[short + 1] = True
        cut[long + 2] = True
        cut[blank + 1] = False
    return np.flatnonzero(cut[:n])


def hashes(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every piece's code points."""
    ends = np.append(starts[1:], len(cps))
    size = int((ends - starts).max())
    base = 0xD6E8FEB86659FD93
    if size < 1 << 16:
        power = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)
        place = np.arange(len(cps)) - np.repeat(starts, ends - starts)
        weighted = tables()[1][cps] * power[place]
    else:
        place = (np.arange(len(cps)) - np.repeat(starts, ends - starts)).astype(np.uint64)
        weighted = mix(tables()[1][cps] ^ mix(place + _U(1)))
    return mix(np.add.reduceat(weighted, starts) + (ends - starts).astype(np.uint64))


class Encoder:
    """Ids of whole texts through a cache of pieces; `encode` turns new pieces into lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = CACHE_PIECES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.off, self.used = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        new = self.encode(pieces)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for x in new for i in x), np.int32, int(counts.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used:self.used + len(flat)] = flat
        index = len(self.off) - 1 + np.arange(len(keys))
        self.off = np.concatenate((self.off, self.used + np.cumsum(counts)))
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, where, keys), np.insert(self.at, where, index)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[where] == keys, self.at[where], -1)

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's rows in order, and their number per row."""
        text, cps, rows = code_points(data, offsets)
        n = len(rows) - 1
        starts = cuts(cps, rows)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        h = hashes(cps, starts)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        index = self._find(keys)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            if len(self.keys) + len(missing) > self.limit:  # emptied: all of this slice's pieces are learnt again
                self.clear()
                missing = np.arange(len(keys))
            a = starts[first[missing]]
            b = np.append(starts[1:], len(cps))[first[missing]]
            self._learn(keys[missing], [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            index = self._find(keys)
        which = index[back]
        counts = (self.off[1:] - self.off[:-1])[which]
        ids = self.ids[expand(self.off[which], counts)]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        at = np.searchsorted(starts, rows)
        return ids, np.diff(ends[at])
