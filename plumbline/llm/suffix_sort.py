"""Two-stage suffix sorting of many short byte strings at once, with numpy.

The strings stand one after another, each closed by a terminator that sorts below every byte, so no suffix reaches into the
next string. A suffix is of type B if it is smaller than its successor and of type A otherwise. Stage one sorts only type B
suffixes directly, eight bytes at a time and only as long as suffixes are still tied. Stage two scans the buckets of first
bytes upwards: a finished suffix at i puts the suffix at i - 1, if that is of type A, next in the bucket of its byte; within a
bucket runs of one byte follow one step after the other. Ties between equal suffixes of different strings keep text order.
"""

from __future__ import annotations

import numpy as np

END = 0  # terminator; bytes are stored one higher


def join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text of all strings with terminators, and the start of each string."""
    size = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(starts[-1], np.int16)
    keep = np.ones(len(text), bool)
    keep[starts[1:] - 1] = False
    text[keep] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    return text, starts[:-1]


def type_b(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; a terminator's suffix counts as B."""
    n = len(text)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(text[1:] - text[:-1])
    up[text == END] = 1  # the empty suffix: nothing is smaller
    known = np.where(up != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]  # the next position where neighbours differ
    return up[nearest] > 0


def packed(text: np.ndarray) -> np.ndarray:
    """Seven symbols from every position as one number."""
    wide = np.concatenate((text, np.zeros(6, text.dtype))).astype(np.int64)
    key = wide[:len(text)].copy()
    for j in range(1, 7):
        key = key << 9 | wide[j:len(text) + j]
    return key


_INSIDE = np.array([-1 << 9 * (7 - k) if k else 0 for k in range(8)], np.int64)  # keeps the first k symbols of a key


def direct_sort(keys: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in lexicographic order, equal ones in text order."""
    if not len(at):
        return at
    group = np.zeros(len(at), np.int64)  # rank so far; ties share it
    order, live, depth = np.argsort(at, kind="stable"), np.arange(len(at)), 0
    at, ends = at[order], ends[order]
    while len(live):
        p, left = at[live] + depth, ends[live] - at[live] - depth
        key = keys[np.minimum(p, len(keys) - 1)] & _INSIDE[np.clip(left, 0, 7)]
        o = np.lexsort((key, group[live]))
        moved = live[o]
        at[live], ends[live], key = at[moved], ends[moved], key[o]
        g = group[live]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        group[live] = live[first]
        depth += 7
        tied = np.bincount(first, minlength=len(live))[first] > 1
        live = live[tied & (at[live] + depth < ends[live])] if tied.any() else live[:0]
        if len(live):  # a suffix that has ended ties only with equal ones; they stay before longer ones
            g = group[live]
            size = np.unique(g, return_counts=True)
            live = live[np.isin(g, size[0][size[1] > 1])]
    return at


def suffix_array(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes that are not empty, in order."""
    n = len(text)
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, np.diff(np.append(starts, n)))  # one past each position's terminator
    kind_b = type_b(text)
    real = text != END
    b = np.flatnonzero(kind_b & real)
    sorted_b = direct_sort(packed(text), b, end_of[b])
    by_byte = text[sorted_b]
    edge = np.searchsorted(by_byte, np.arange(258))
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]

    def give(found: np.ndarray) -> None:
        """Predecessors of type A go to the buckets of their bytes, in the order of their successors."""
        prev = found[~is_start[found]] - 1
        prev = prev[~kind_b[prev]]
        c = text[prev]
        o = np.argsort(c, kind="stable")
        prev, c = prev[o], c[o]
        cut = np.flatnonzero(np.diff(c)) + 1
        for part in np.split(prev, cut):
            if len(part):
                waiting[text[part[0]]].append(part)

    give(np.flatnonzero(~real))  # the empty suffixes come first
    out = []
    for c in range(1, 257):
        head = []
        while waiting[c]:  # what this step adds may add more of the same byte
            step = np.concatenate(waiting[c])
            waiting[c] = []
            head.append(step)
            give(step)
        mine = sorted_b[edge[c]:edge[c + 1]]
        out += [*head, mine]
        if len(mine):
            give(mine)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, starts: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of every suffix with the one before it in order, counted up to `most`."""
    ends = np.append(starts[1:], len(text)) - 1
    left = np.repeat(ends, np.diff(np.append(starts, len(text)))) - np.arange(len(text))  # bytes up to the terminator
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    bound = np.minimum(np.minimum(left[a], left[b]), most)
    keys, live, depth = packed(text), np.arange(len(a)), 0
    while len(live):  # seven symbols at a time, then the first of them that differs
        x = keys[np.minimum(a[live] + depth, len(keys) - 1)] ^ keys[np.minimum(b[live] + depth, len(keys) - 1)]
        equal = sum((x >> 9 * k == 0).astype(np.int64) for k in range(7))
        out[1:][live] = np.minimum(depth + equal, bound[live])
        depth += 7
        live = live[(equal == 7) & (bound[live] > depth)]
    return out
