"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

A text is lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters. The automaton of all items' word
sequences is built per part of the benchmark (parts are cut by size, so one broadcast is bounded), and each document's words
are streamed through it: after every word the automaton knows the longest suffix of the document read so far that occurs in
an item. A suffix of `window` words or more, or one that is a whole shorter item, is a hit. Runs of hit words are removed; a
document of which more than `max_coverage` of the words are hit goes altogether.

Only stretches of words whose every neighbouring pair occurs in some item are streamed: no other stretch can hold a match of
two words. That test is one binary search per word in numpy.

Defined cases: a null or empty text has no words, no hits, and stays as it is. A benchmark row without words is no window. A
benchmark row without id marks words, but is not listed. Repeated benchmark rows count once. An empty benchmark hits nothing.
A null document id is carried through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import ALNUM, LOWER, expand, lists, slices, text_buffer, words
from .common import carried, even, fields, in_arrow, narrow, query, table

WINDOW = 10
PART_BYTES = 8 << 20  # item text per automaton
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """Suffix automaton over numbered words; state 0 is the root."""

    window: int
    number: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    long_items: dict[int, set[int]] = field(default_factory=dict)  # state of a window: items
    short_items: dict[tuple[int, int], set[int]] = field(default_factory=dict)  # (state, words): shorter items that end here
    nameless: set[tuple[int, int]] = field(default_factory=set)

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.longest.append(longest)
        self.step.append(step)
        self.link.append(link)
        return len(self.longest) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, cut down to the strings that end p's."""
        q = self.step[p][c]
        if self.longest[q] == self.longest[p] + 1:
            return q
        clone = self._state(self.longest[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            p = last
            if c in self.step[p]:
                last = self._split(p, c)
                continue
            new = self._state(self.longest[last] + 1, {}, 0)
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def suffix(self, state: int, length: int) -> int:
        """The state of the last `length` words of a match that ends in `state`."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, sequence):
        """After each word: (state, length of the longest match that ends here)."""
        state = length = 0
        for c in sequence:
            while state and c not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if c in self.step[state]:
                state = self.step[state][c]
                length += 1
            else:
                length = 0
            yield state, length

    def name(self, item: int | None, sequence: list[int]) -> None:
        """Attach an item to the windows it has."""
        size = min(self.window, len(sequence))
        for state, length in self.walk(sequence):
            if length < size:
                continue
            at = self.suffix(state, size)
            home = self.long_items.setdefault(at, set()) if size == self.window else self.short_items.setdefault((at, size), set())
            if item is not None:
                home.add(item)

    def finish(self, seen: list[list[int]]) -> Automaton:
        """Arrays for the filter of neighbouring pairs."""
        v = len(self.number)
        data = b" ".join(self.number)
        if v:
            buf = np.frombuffer(data, np.uint8)
            _, _, _, h = words(buf, np.array([0, len(buf)], np.int64), ALNUM)
            order = np.argsort(h)
            self.hashes, self.ids = h[order], order.astype(np.int64)
        else:
            self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pairs = {a * v + b for s in seen for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.short_sizes = sorted({n for _, n in self.short_items})
        self.least = min([self.window] * bool(self.long_items) + self.short_sizes, default=0)
        return self

    def hits(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges covered by windows, and the items they belong to."""
        spans, items = [], set()
        for j, (state, length) in enumerate(self.walk(sequence)):
            for size in (*self.short_sizes, self.window):
                if length < size:
                    break
                at = self.suffix(state, size)
                found = self.long_items.get(at) if size == self.window else self.short_items.get((at, size))
                if found is not None:
                    items |= found
                    spans.append((j + 1 - size, j + 1))
        return spans, items


def build(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Automaton:
    auto, kept = Automaton(window), []
    for item, text in rows:
        found = WORD.findall((text or "").encode().lower())
        if found:
            kept.append((item, [auto.number.setdefault(w, len(auto.number)) for w in found]))
    for _, s in kept:
        auto.add(s)
    for item, s in kept:
        auto.name(item, s)
    return auto.finish([s for _, s in kept])


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def scan(data: np.ndarray, offsets: np.ndarray, auto: Automaton):
    """For one slice: word starts, ends, rows, hit flags, and (row, item) pairs found."""
    low = LOWER[data]
    start, end, row, h = words(low, offsets, ALNUM)
    hit = np.zeros(len(h), bool)
    items: set[tuple[int, int]] = set()
    if not len(h) or not auto.least:
        return start, end, row, hit, items
    known, at = _member(auto.hashes, h)
    ids = np.where(known, auto.ids[at], -1)
    joined = (row[1:] == row[:-1]) & known[1:] & known[:-1]
    if len(auto.pairs):
        where = np.flatnonzero(joined)
        ok, _ = _member(auto.pairs, ids[where] * len(auto.number) + ids[where + 1])
        joined[where] = ok
    else:
        joined[:] = False
    edge = np.flatnonzero(np.concatenate(([True], ~joined, [True])))  # runs of joined words
    size = np.diff(edge)
    for a, n in zip(edge[:-1][size >= auto.least], size[size >= auto.least], strict=True):
        if not known[a]:
            continue
        seq = [auto.number.get(low[start[k]:end[k]].tobytes(), -1) for k in range(a, a + n)]  # exact words, not their hashes
        spans, found = auto.hits(seq)
        for s, e in spans:
            hit[a + s:a + e] = True
        items |= {(int(row[a]), i) for i in found}
    return start, end, row, hit, items


def _pass(batches, auto, texts):
    auto = auto.value
    for batch in batches:
        for part, data, off in slices(batch):
            start, end, row, hit, items = scan(data, off, auto)
            n = part.num_rows
            prior, old = part.column("hits"), part.column("items").to_pylist()
            flat, counts = prior.flatten().to_numpy(), prior.value_lengths().fill_null(0).to_numpy()
            first = np.searchsorted(row, np.arange(n))  # index of each row's first word
            hit[expand(flat[0::2] + np.repeat(first, counts // 2), flat[1::2] - flat[0::2])] = True
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cut = np.flatnonzero((row[1:] != row[:-1]) & hit[1:] & hit[:-1]) + 1  # a run that crosses rows is two runs
            a, b = np.sort(np.concatenate((a, cut))), np.sort(np.concatenate((b, cut)))
            owner = row[a]
            runs = np.stack((a - first[owner], b - first[owner]), 1).ravel().astype(np.int64)
            ranges = np.stack((start[a] - off[owner], end[b - 1] - off[owner]), 1).ravel().astype(np.int64)
            each = np.bincount(owner, minlength=n) * 2
            found = [set(x or ()) for x in old]
            for r, i in items:
                found[r].add(i)
            yield [part.column("doc_id"), part.column("text") if texts else pa.nulls(n, pa.string()),
                   pa.array(np.bincount(row, minlength=n).astype(np.int64)), lists(runs, each, pa.int64()), lists(ranges, each, pa.int64()),
                   pa.array([sorted(x) for x in found], pa.list_(pa.int64())), *([part.column("carried")] if "carried" in part.schema.names else [])]


def _without(batches, limit):
    for batch in batches:
        for part, data, off in slices(batch):
            texts = part.column("text").to_pylist()
            ranges, counts = part.column("ranges").to_pylist(), part.column("coverage").to_pylist()
            for i, r in enumerate(ranges):
                if r:
                    raw, at, kept = data[off[i]:off[i + 1]].tobytes(), 0, []
                    for s, e in zip(r[0::2], r[1::2], strict=True):
                        kept.append(raw[at:s])
                        at = e
                    texts[i] = None if counts[i] > limit else b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            yield [part.column("doc_id"), part.column("n_words"), part.column("n_hit"), part.column("items"), part.column("ranges"),
                   part.column("coverage"), pa.array([c > limit for c in counts]), pa.array(texts, pa.string()), part.column("carried")]


def _cleaned(batches, auto, limit):
    """The last pass and the removal in one worker: a second one for each task would stay with the executor, memory and all."""
    for doc_id, text, n_words, hits, ranges, items, rest in _pass(batches, auto, True):
        flat, counts = hits.flatten().to_numpy(), hits.value_lengths().to_numpy()
        sums = np.concatenate(([0], np.cumsum(flat[1::2] - flat[0::2])))
        ends = np.concatenate(([0], np.cumsum(counts // 2)))
        n, n_hit = n_words.to_numpy(), sums[ends[1:]] - sums[ends[:-1]]
        coverage = np.where(n > 0, n_hit / np.maximum(n, 1), 0.0)
        found = {"doc_id": doc_id, "text": text, "n_words": n_words, "n_hit": pa.array(n_hit, pa.int64()), "items": items, "ranges": ranges, "coverage": pa.array(coverage), "carried": rest}
        yield from _without([pa.RecordBatch.from_pydict(found)], limit)


def _passes(docs: DataFrame, items: DataFrame, window: int, doc_id: str, text: str, item_id: str, item_text: str, texts: bool,
            end: tuple[Callable, str] | None = None) -> DataFrame:
    """The passes over all parts of the benchmark; `end` is what the last one runs in place of _pass, and the fields it yields between doc_id and carried."""
    spark = docs.sparkSession
    bench = narrow(items, item_id=item_id, text=item_text).distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    rest = [carried(docs, doc_id, text)] if texts else []
    out = even(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), *rest), "doc_id").withColumns(
        {"n_words": F.lit(0).cast("bigint"), **{c: F.array().cast("array<bigint>") for c in ("hits", "ranges", "items")}})
    for p in range(parts):
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else bench
        rows = [(r[0], r[1]) for r in mine.collect()]  # about PART_BYTES of text
        auto = spark.sparkContext.broadcast(build(rows, window))
        keep = texts or p + 1 < parts
        kind = fields("text string, n_words bigint, hits array<bigint>, ranges array<bigint>, items array<bigint>", *([out.schema["carried"]] if texts else []))
        kind = StructType([out.schema["doc_id"], *kind.fields])
        out = out.select("doc_id", "text", "n_words", "hits", "ranges", "items", *["carried"] * texts)
        if end and p + 1 == parts:
            return in_arrow(out, lambda b, auto=auto: end[0](b, auto), StructType([out.schema["doc_id"], *fields(end[1], out.schema["carried"]).fields]))
        out = in_arrow(out, lambda b, auto=auto, keep=keep: _pass(b, auto, keep), kind)
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, text, n_words, hits, ranges, items of every document; with `texts` also `carried` (its other columns), else text is null.

    hits are word ranges and ranges byte ranges [first, last), both flat and merged; items are the ids found.
    """
    return _passes(docs, items, window, doc_id, text, item_id, item_text, texts)


def _hit_words():
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda s, x: s + x)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, ranges, coverage, dropped, text (hit runs removed; null where the document is dropped), carried."""
    kind = "n_words bigint, n_hit bigint, items array<bigint>, ranges array<bigint>, coverage double, dropped boolean, text string"
    return _passes(docs, items, window, doc_id, text, item_id, item_text, True, (lambda b, auto: _cleaned(b, auto, max_coverage), kind))


@query(r"""WITH w AS (SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x00-\x2F\x3A-\x60\x7B-\x7F]+',' ','g')),' ') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10,len(w)) AS k FROM w WHERE w<>['']),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1],' ') AS g FROM (SELECT item_id,w,k,unnest(range(1,len(w)-k+2)) AS i FROM items)),
d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x00-\x2F\x3A-\x60\x7B-\x7F]+',' ','g')),' ') AS w FROM documents),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1],' ') AS g FROM (SELECT doc_id,w,k,unnest(range(1,len(w)-k+2)) AS i FROM d, (SELECT DISTINCT k FROM items) WHERE w<>[''])),
f AS (SELECT doc_id,i,g.k,item_id FROM g JOIN windows USING (k,g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i,i+k)) AS p FROM (SELECT DISTINCT doc_id,i,k FROM f)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s,',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM f) GROUP BY 1)
SELECT d.doc_id, CASE WHEN w=[''] THEN 0 ELSE len(w) END::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op10_decontaminate(spark, d):
    """Words of every document that lie inside a ten-word window of a benchmark item."""
    found = matches(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", _hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
