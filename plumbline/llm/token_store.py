"""Token ids in directly addressable code files.

A segment holds the ids of consecutive documents. Ids are split into chunks of 8 bits by level: level 0 has the lowest chunk
of every id, a bitmap says which ids go on, level 1 has the next chunk of those, and so on. A directory of set bits before
every 512 bits of a bitmap makes rank a look-up, so any id is read from one chunk and one rank per level, without decoding a
block. A segment is a self-delimiting byte string:

    header  magic "DAC1", total bytes (u64), shard, sequence (u32), documents, ids (u64), levels (u32), first id of the shard (u64)
    per document   id present (u8), id (i64), first id in the segment (u64)
    per level      entries (u64), chunks (u8), continuation bitmap (little bit order), rank directory (u32 per 512 bits)

Documents are range-partitioned and sorted by id, so shards and, within them, segments ascend. Spark's own writer commits the
files (one segment each, at most SEGMENT_IDS ids unless one document is longer), so lost tasks leave nothing behind.

A text that holds the string of one of the tokenizer's added tokens is encoded by the library as it is, like any plain call does.

Defined cases: a null or empty text has only the end id; a null document id sorts first and is kept as null; rows that repeat
an id are all stored, in the order of their texts; an empty table gives no segment.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import new_path
from .arrays import expand, slices
from .common import CACHES, in_arrow, materialise, narrow, query, table, task_count
from .pieces import SLICE_BYTES, Encoder

MAGIC = b"DAC1"
HEADER = struct.Struct("<4sQIIQQIQ")
SEGMENT_IDS = 6 << 20
STEP = 512
END_ID = 2
_ENCODERS: dict[tuple, Encoder] = {}
CACHES.append((__name__, _ENCODERS))


def library_encoder(path: str, per_text: int = 400):
    """New pieces through the tokenizers library, many per call: pieces joined by line feeds are cut back at their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # a piece is ordinary text; texts that hold an added token are left to marked_texts
    ids = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    feed = ids(["\n"])[0]

    def encode(pieces: list[str]) -> list[list[int]]:
        plain = [i for i, p in enumerate(pieces) if len(feed) == 1 and not p.isspace()]
        out: list[list[int] | None] = [None] * len(pieces)
        groups = [plain[i:i + per_text] for i in range(0, len(plain), per_text)]
        for group, found in zip(groups, ids(["\n".join(pieces[i] for i in g) for g in groups]), strict=True):
            cut, part = [], []
            for t in found:
                if t == feed[0]:
                    cut.append(part)
                    part = []
                else:
                    part.append(t)
            cut.append(part)
            if len(cut) == len(group):
                for i, x in zip(group, cut, strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, ids([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return encode


def marked_texts(path: str):
    """The strings of the tokenizer's added tokens, and the library's own encoding for the texts that hold one."""
    if ("added", path) not in _ENCODERS:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        _ENCODERS["added", path] = [t.content for t in tok.get_added_tokens_decoder().values()], lambda text: tok.encode(text, add_special_tokens=False).ids
    return _ENCODERS["added", path]


def encoder(path: str) -> Encoder:
    if ("tokenizers", path) not in _ENCODERS:
        _ENCODERS["tokenizers", path] = Encoder(library_encoder(path))
    return _ENCODERS["tokenizers", path]


def pack(ids: np.ndarray, doc_ids: list, starts: np.ndarray, shard: int = 0, sequence: int = 0, first: int = 0) -> bytes:
    """One segment. starts: the first id of every document, ascending."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = (rest >> 8) > 0
        bits = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), STEP // 8), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        rank = np.concatenate(([0], np.cumsum(sums)[:-1])).astype("<u4") if len(sums) else sums
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    docs = (np.array([d is not None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
            + np.asarray(starts, "<u8").tobytes())
    body = docs + b"".join(levels)
    return HEADER.pack(MAGIC, HEADER.size + len(body), shard, sequence, len(doc_ids), len(ids), len(levels), first) + body


class Segment:
    """A segment over its bytes; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, self.size, self.shard, self.sequence, n, self.count, levels, self.first = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        p = at + HEADER.size

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal p
            out = np.frombuffer(data, kind, k, p)
            p += out.nbytes
            return out

        present, numbers = take("u1", n), take("<i8", n)
        self.doc_ids = [int(x) if ok else None for ok, x in zip(present, numbers, strict=True)]
        self.starts = take("<u8", n).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            m = int(take("<u8", 1)[0])
            self.levels.append((take("u1", m), take("u1", -(-m // 8)), take("<u4", -(-m // STEP))))

    def take(self, positions) -> np.ndarray:
        """The ids at any positions of the segment."""
        at = np.asarray(positions, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, rank) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.levels):
                break
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[on], at[on]
            if len(at) * STEP // 8 > len(bits):  # many positions: one running count serves all of them
                ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[at >> 3]
            else:  # the directory's entry and the full bytes between it and the bit's byte
                block = at // STEP
                whole = (at >> 3) - block * (STEP // 8)
                part = np.concatenate(([0], np.cumsum(np.bitwise_count(bits[expand(block * (STEP // 8), whole)]), dtype=np.int64)))
                edge = np.concatenate(([0], np.cumsum(whole)))
                ones = rank[block] + part[edge[1:]] - part[edge[:-1]]
            inside = np.bitwise_count(bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
            at = (ones + inside).astype(np.int64)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.take([i])[0])

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.count
        return self.take(np.arange(self.starts[k], end))


def segments(data: bytes):
    at = 0
    while at < len(data):
        s = Segment(data, at)
        yield s
        at += s.size + 1  # the writer ends every row by one byte


def _encode(batches, path, end_id, most):
    from pyspark import TaskContext
    shard, enc = TaskContext.get().partitionId(), encoder(path)
    added, whole = marked_texts(path)
    docs, counts, held, size, sequence, first = [], [], [], 0, 0, 0

    def flush():
        starts = np.concatenate(([0], np.cumsum(np.concatenate(counts))[:-1]))
        return [pa.array([shard], pa.int32()), pa.array([pack(np.concatenate(held), docs, starts, shard, sequence, first)], pa.binary())]

    for batch in batches:
        for part, data, off in slices(batch, limit=SLICE_BYTES):
            ids, n = enc.slice_ids(data, off)
            texts = part.column("text")
            marked = np.zeros(part.num_rows, bool)
            for token in added:
                marked |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
            if marked.any():
                rows = np.split(ids, np.cumsum(n)[:-1])
                for i in np.flatnonzero(marked):
                    rows[i] = np.array(whole(texts[i].as_py()), ids.dtype)
                ids, n = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            if docs and size + len(ids) > most:
                yield flush()
                first, sequence = first + size, sequence + 1
                docs, counts, held, size = [], [], [], 0
            docs += part.column("doc_id").to_pylist()
            counts.append(n)
            held.append(ids)
            size += len(ids)
    if docs:
        yield flush()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text",
          segment_ids: int = SEGMENT_IDS) -> str:
    """Encode every text and write segment files below `path` in ascending document order."""
    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = rows.repartitionByRange(task_count(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    made = in_arrow(ordered, lambda b: _encode(b, tokenizer, end_id, segment_ids), "shard int, segment binary")
    made.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def _documents(batches):
    for batch in batches:
        for content in batch.column("content"):
            for s in segments(content.as_buffer().to_pybytes()):
                n = len(s.doc_ids)
                length = np.diff(np.append(s.starts, s.count))
                flat = s.take(np.arange(s.count)).astype("<u4")
                crc = [zlib.crc32(flat[a:a + k].tobytes()) for a, k in zip(s.starts.tolist(), length.tolist(), strict=True)]
                yield [pa.array([s.shard] * n, pa.int32()), pa.array([s.sequence] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()),
                       pa.array(s.starts + s.first), pa.array(length), pa.array(crc, pa.int64())]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = materialise(in_arrow(files, _documents, "shard int, sequence int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"), "stored")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard: as many as the writer had partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query()
def op8_token_store(spark, d):
    """Every document's place, length and checksum, read back from the files of its ids."""
    import public_tokenizers
    path = write(table(spark, d, "documents"), new_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
