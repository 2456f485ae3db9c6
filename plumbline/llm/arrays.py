"""Texts as byte arrays inside a task: slices of bounded size, words with hashes, packed results.

Words are found and hashed for a whole slice at once with numpy; a word's 64-bit hash depends on its bytes only. Slices and
blocks bound the memory of a task: a block is cut at a separator, so even one very long text is never hashed in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # texts handed to numpy at once; one longer text forms a slice of its own
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)


BYTE_VALUES = _table(20260101)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, True where a byte belongs to a word; ranges (first, last) are the separators."""
    word = np.ones(256, bool)
    for a, b in ranges:
        word[a:b + 1] = False
    return word


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with len(data) + 1 entries; (C[e] - C[s]) * base**-s identifies data[s:e]."""
    up, _ = powers(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, dtype=np.uint64, out=c[1:])
    return c


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    b = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if b.null_count:
        b = pc.fill_null(b, b"")
    if not len(b):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = b.buffers()
    offsets = np.frombuffer(off, np.int64)[b.offset:b.offset + len(b) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most `limit` bytes of text (one row at least), each with its bytes and offsets."""
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def _blocks(is_word: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most about BLOCK_BYTES that end at a row's end or behind a separator."""
    n, a = len(is_word), 0
    while a < n:
        b = min(n, a + BLOCK_BYTES)
        if b < n and is_word[b - 1]:
            k = int(np.searchsorted(offsets, b, "right")) - 1
            gaps = np.flatnonzero(~is_word[a:b])
            cut = max(int(offsets[k]), a + int(gaps[-1]) + 1 if len(gaps) else a)
            if cut <= a:  # one word fills the block: go on to its end
                more = np.flatnonzero(~is_word[b:])
                cut = min(b + int(more[0]) if len(more) else n, int(offsets[k + 1]))
            b = cut
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the lower-cased bytes: start, end, row, 64-bit hash. Words never cross rows."""
    is_word = table[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts, ends, hashes = [], [], []
    for a, b in _blocks(is_word, offsets):
        w = is_word[a:b]
        begin = w.copy()
        begin[1:] &= ~w[:-1] | first[a + 1:b]
        end = w.copy()
        end[:-1] &= ~w[1:] | first[a + 1:b]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        c = prefix_hashes(data[a:b])
        down = powers(b - a)[1]
        hashes.append(mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    return s, e, np.searchsorted(offsets, s, "right") - 1, np.concatenate(hashes)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of every list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every pair, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep].astype(np.int64), counts[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    out[at] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)
