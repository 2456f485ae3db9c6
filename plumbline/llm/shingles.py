"""Sets of word shingles of whole texts: their sizes, fingerprints, bottom-k sketches and, where asked for, all their hashes.

Words are runs of bytes other than white space, lower-cased in A-Z. A shingle is `width` consecutive words; a text of fewer
words has its whole sequence as its one shingle; a text without words has the empty set. One 64-bit hash stands for a shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .arrays import LOWER, WHITE, lists, mix, slices, words

_U = np.uint64
_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    _, _, row, h = words(LOWER[data], offsets, WHITE)
    n, w = len(offsets) - 1, len(h)
    first = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(first)
    full = max(w - width + 1, 0)
    value = np.zeros(w, np.uint64)
    for j in range(width):
        value[:full] += mix(h[j:j + full] * _FACTORS[j])
    value = mix(value)
    out = []
    for a, k in zip(first.tolist(), size.tolist(), strict=False):
        if k >= width:
            out.append(np.unique(value[a:a + k - width + 1]))
        elif k:
            short = sum(int(mix(h[a + j:a + j + 1] * _FACTORS[j])[0]) for j in range(k)) + k
            out.append(mix(np.array([short & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def profile(batches, width: int, keep: int):
    """id, set size, fingerprint of the whole set, bottom-k sketch (ascending as unsigned numbers, stored as signed)."""
    for batch in batches:
        for part, data, off in slices(batch):
            sets = shingle_sets(data, off, width)
            head = [s[:keep] for s in sets]
            yield [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                   pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                   lists(np.concatenate(head).view(np.int64) if head else np.zeros(0, np.int64), np.array([len(x) for x in head]), pa.int64())]


def full_sets(batches, width: int):
    """id and all shingle hashes of every text."""
    for batch in batches:
        for part, data, off in slices(batch):
            yield [part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(data, off, width)], pa.binary())]
