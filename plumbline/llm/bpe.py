"""Byte-level BPE by DuckDB recursive queries inside each task, for any rank file of the tiktoken kind.

Spark spreads the documents; a task cuts its texts into pieces (see pieces.py) and every distinct new piece becomes
token-position rows of an in-process DuckDB table. The recursive query joins neighbouring rows with the merge table and
contracts each piece's leftmost pair of the lowest rank, until no piece has a pair left. A piece that is itself a token needs
no merge. Ids of a text are its pieces' ids in order; decoding joins ids with their bytes and aggregates them in order.

A piece of more than LONG_PIECE bytes would take as many rounds as it has bytes, each over all of them; it is contracted by
the same rule with a heap, whose cost is not quadratic. Both give the same ids.

Defined cases: a null or empty text has no ids and decodes to the empty string; any text decodes to its own bytes; repeated
rows are encoded alike. A rank file without all 256 single bytes is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .arrays import lists, slices
from .common import CACHES, carried, even, fields, in_arrow, narrow, query, table
from .pieces import Encoder

LONG_PIECE = 256
DUCK_MEMORY = "128MB"
DUCK_PIECES = 15_000  # in one recursive query
DUCK_IDS = 100_000  # in one decoding query
TEXT_BYTES = 1 << 19  # of text in numpy at once: a worker's peak is mostly the arrays of one such slice and the vocabulary
MERGE = """
WITH RECURSIVE step(piece, place, id, round) AS (
    SELECT piece, place, id, 0 FROM fresh
    UNION ALL
    (WITH pairs AS (SELECT piece, place, id, lead(id) OVER w AS next_id, lead(place) OVER w AS gone, lead(piece) OVER w AS next_piece FROM step WINDOW w AS (ORDER BY place)),
          best AS (SELECT piece, min(merged << 32 | place) AS least, arg_min(gone, merged << 32 | place) AS gone
                   FROM pairs JOIN merges ON pair = id << 20 | next_id WHERE next_piece = piece GROUP BY piece)
     SELECT piece, place, CASE WHEN place = least & 4294967295 THEN least >> 32 ELSE id END, round + 1
     FROM step JOIN best USING (piece) WHERE place <> gone))
SELECT piece, list(id ORDER BY place) AS ids FROM step JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) USING (piece, round)
GROUP BY piece ORDER BY piece
"""  # place: byte position among all fresh pieces
DECODE = "SELECT text, from_hex(string_agg(v.hex, '' ORDER BY place)) AS bytes FROM coded JOIN vocabulary v USING (id) GROUP BY text ORDER BY text"
_MACHINES: dict[str, Machine] = {}
CACHES.append((__name__, _MACHINES))
CACHE_PIECES = 600_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Machine:
    """One task process's DuckDB tables of a vocabulary, and its cache of encoded pieces."""

    def __init__(self, path: str):
        import duckdb
        self.rank = ranks(path)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        merges = [(self.rank[t[:i]] << 20 | self.rank[t[i:]], k) for t, k in self.rank.items() for i in range(1, len(t))
                  if t[:i] in self.rank and t[i:] in self.rank]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY})
        pairs, out = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self._table("merges", pair=pairs, merged=out)
        self._table("vocabulary", id=np.array(list(self.rank.values()), np.int64), hex=[t.hex() for t in self.rank])
        self.encoder = Encoder(self.encode, CACHE_PIECES)

    def _table(self, name: str, **columns) -> None:
        arrow = pa.table(columns)
        self.duck.register("incoming", arrow)
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.duck.unregister("incoming")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        out: list = [[self.rank[r]] if r in self.rank else None for r in raw]
        every = [i for i, r in enumerate(raw) if out[i] is None and len(r) <= LONG_PIECE]
        for a in range(0, len(every), DUCK_PIECES):
            rows = every[a:a + DUCK_PIECES]
            size = np.array([len(raw[i]) for i in rows])
            data = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)
            self._table("fresh", piece=np.repeat(np.arange(len(rows)), size), place=np.arange(len(data)), id=self.byte_id[data])
            found = [ids for _, ids in self.duck.execute(MERGE).fetchall()]
            for i, ids in zip(rows, found, strict=True):
                out[i] = ids
        return [self.contract(r) if x is None else x for r, x in zip(raw, out, strict=True)]

    def contract(self, raw: bytes) -> list[int]:
        """The same rule for one long piece, with a heap of pairs."""
        tokens: list = [bytes([b]) for b in raw]
        nxt, prv = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(tokens) and (k := self.rank.get(both := tokens[i] + tokens[nxt[i]])) is not None:
                heapq.heappush(heap, (k, i, both))

        for i in range(len(tokens)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if tokens[i] is None or nxt[i] >= len(tokens) or len(tokens[i]) + len(tokens[nxt[i]]) != len(both):
                continue
            j = nxt[i]
            tokens[i], tokens[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < len(tokens):
                prv[nxt[j]] = i
            offer(i)
            offer(prv[i])
        return [self.rank[t] for t in tokens if t is not None]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        out = [b""] * len(counts)
        size = np.cumsum(counts) - counts
        self._table("coded", text=np.repeat(np.arange(len(counts)), counts), place=np.arange(len(ids)) - np.repeat(size, counts), id=ids.astype(np.int64))
        for i, b in self.duck.execute(DECODE).fetchall():
            out[i] = b
        return out


def machine(path: str) -> Machine:
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path)
    return _MACHINES[path]


def _encode(batches, path):
    m = machine(path)
    for batch in batches:
        for part, data, off in slices(batch, limit=TEXT_BYTES):
            ids, n = m.encoder.slice_ids(data, off)
            yield [part.column("doc_id"), lists(ids, n, pa.int32())]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of every text."""
    kind = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>"
    return in_arrow(even(narrow(docs, doc_id=doc_id, text=text), "doc_id"), lambda b: _encode(b, path), kind)


def _pieces(ids: np.ndarray, counts: np.ndarray, most: int = DUCK_IDS):
    """Row ranges with at most `most` ids (one row at least)."""
    ends, i = np.cumsum(counts), 0
    while i < len(counts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(i, j), ids[before:ends[j - 1]]
        i = j


def _decode(batches, path, digest):
    m = machine(path)
    for batch in batches:
        column = batch.column("ids")
        counts, ids = column.value_lengths().fill_null(0).to_numpy(), column.flatten().to_numpy()
        for rows, mine in _pieces(ids, counts):
            found = m.decode(mine, counts[rows])
            first = batch.column("doc_id")[rows]
            if digest:
                at = np.concatenate(([0], np.cumsum(counts[rows])))
                raw = mine.astype("<u4")
                yield [first, pa.array(counts[rows].astype(np.int64)), pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]),
                       pa.array([hashlib.sha256(x).hexdigest() for x in found])]
            else:
                yield [first, pa.array(found, pa.binary())]


def decode(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes of every list of ids."""
    kind = f"doc_id {coded.schema[doc_id].dataType.simpleString()}, bytes binary"
    return in_arrow(narrow(coded, doc_id=doc_id, ids=ids), lambda b: _decode(b, path, False), kind)


def _round_trip(batches, path):
    m = machine(path)
    for batch in batches:
        for part, data, off in slices(batch, limit=TEXT_BYTES):
            ids, n = m.encoder.slice_ids(data, off)
            found = [x for rows, mine in _pieces(ids, n) for x in m.decode(mine, n[rows])]
            yield [part.column("doc_id"), lists(ids, n, pa.int32()), pa.array(found, pa.binary()), part.column("carried")]


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, bytes (decoded from the ids), carried (the other columns) of every text."""
    base = even(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), carried(docs, doc_id, text)), "doc_id")
    kind = fields("ids array<int>, bytes binary", base.schema["carried"])
    return in_arrow(base, lambda b: _round_trip(b, path), StructType([base.schema["doc_id"], *kind.fields]))


def digests(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded texts; the bytes stay in the task that decodes them."""
    kind = f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return in_arrow(coded, lambda b: _decode(b, path, True), kind)


@query()
def op7_byte_bpe(spark, d):
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, d, "documents"), path), path)
