"""Removal of repeated 100-byte strings: suffix arrays over the places where texts share content.

A string of LENGTH bytes that occurs twice has the same smallest hash of GRAM bytes in both places, its anchor. Every text is
cut into the runs of windows that share an anchor; a run's bytes are its context.

1. Per slice of texts numpy finds anchors and contexts. Contexts equal to an earlier one of the slice are covered at once, so
   a hot passage leaves a slice once. The others go, packed, to the task that owns the anchor's hash.
2. That task covers every context equal to an earlier one. Anchors with a single context are done; where an anchor has several
   contexts, the first of each is named, for its windows may still match those of another.
3. The bytes of those contexts are read again and meet by anchor. Their suffixes are sorted in two stages (suffix_sort.py);
   neighbours with a common prefix of LENGTH bytes are equal windows, and all but the earliest are covered.
4. An anchor with more than WIDE contexts, or one that a sample of documents shows to be hot, is never gathered: its windows
   are spread one by one by their own hash and treated as contexts of one window, for which step 2 says all.
5. Covered windows are collected per document and joined with the texts.

The sample only chooses between the equal ways 3 and 4. Contexts are compared by 96 bits of hashes, windows of step 3 byte by
byte.

Defined cases: a null text is empty; a text shorter than LENGTH keeps everything. A row without id is kept whole and is nobody's
earlier copy. Of rows that repeat an id with different texts the one with the smallest hash is the document, the others are kept
whole; rows that repeat both id and text are one document and get its result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import expand, mix, powers, prefix_hashes, slices
from .common import carried, even, fields, in_arrow, materialise, query, table, task_count
from .suffix_sort import common_prefixes, join, suffix_array

LENGTH = 100
GRAM = 32
WIDE = 4000
SEGMENT = 2 << 20
PLACE = 22  # bits of a position inside a segment
SAMPLE = 2000
SORT_BYTES = 1 << 20
_U = np.uint64
RECORD = np.dtype([("h", "<u8"), ("c", "<u4"), ("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
ROUTED = "bucket int, kind int, payload binary"
FOUND = "doc bigint, kind int, payload binary"
COVERED, NAMED, SPREAD = range(3)


def contexts(data: np.ndarray, length: int) -> np.ndarray:
    """h, c, lo, hi of every run of windows with one anchor; data is one segment without text borders inside its windows."""
    n, q = len(data), GRAM
    c, (_, down) = prefix_hashes(data), powers(n + 1)
    gram = mix((c[q:] - c[:-q]) * down[:n - q + 1])
    low = _U((1 << PLACE) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, done = length - q + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[:len(least) - (width - done)], least[width - done:])
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    out = np.zeros(len(first), RECORD)
    out["lo"], out["hi"], out["h"] = first, last, gram[at[first]]
    e = last + length
    out["c"] = (mix((c[e] - c[first]) * down[first] + (e - first).astype(np.uint64)) >> _U(32)).astype(np.uint32)
    return out


def _records(batch: pa.RecordBatch, length: int):
    """Per slice: the records of all its documents."""
    for part, data, off in slices(batch):
        found = []
        for doc, a, b in zip(part.column("doc").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            for s in range(a, b - length + 1, SEGMENT):
                r = contexts(data[s:min(b, s + SEGMENT + length - 1)], length)
                r["doc"] = doc
                r["lo"] += s - a
                r["hi"] += s - a
                found.append(r)
        if found:
            yield np.concatenate(found)


def _firsts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records ordered by content and place, and True for the first of every content."""
    r = r[np.lexsort((r["lo"], r["doc"], r["c"], r["h"]))]
    new = np.ones(len(r), bool)
    new[1:] = (r["h"][1:] != r["h"][:-1]) | (r["c"][1:] != r["c"][:-1])
    return r, new


def _packed(r: np.ndarray, buckets: int, kind: int, hot: np.ndarray):
    """Rows (bucket, kind, payload) of records; those of a hot anchor are dealt by their content, covered ones by their document."""
    key = r["doc"].astype(np.uint64) if kind == COVERED else r["h"].copy()
    if len(hot):
        key = np.where(np.isin(key, hot), mix(key + r["c"]), key)
    bucket = (mix(key) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    r, bucket = r[order], bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))[: None if len(r) else 0]
    at = bucket[edge[:-1]]
    return [pa.array(at, pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array([r[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())]


def _route(batches, length, buckets, hot):
    for batch in batches:
        for r in _records(batch, length):
            r, new = _firsts(r)
            yield _packed(r[new], buckets, NAMED, hot)
            if not new.all():
                yield _packed(r[~new], buckets, COVERED, hot)


def _by_document(r: np.ndarray, kind: int) -> list[pa.Array]:
    """Rows (doc, kind, payload) with the ranges of each document's records."""
    r = r[np.argsort(r["doc"], kind="stable")]
    edge = np.flatnonzero(np.concatenate(([True], r["doc"][1:] != r["doc"][:-1], [True])))[: None if len(r) else 0]
    return [pa.array(r["doc"][edge[:-1]], pa.int64()), pa.array([kind] * (len(edge) - 1), pa.int32()),
            pa.array([r[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())]


def _meet(group: pa.Table, hot: np.ndarray, wide: int) -> pa.Table:
    """One bucket: cover later equal contexts, name the first ones of anchors with several."""
    kind = group.column("kind").to_numpy()
    raw = group.column("payload").to_pylist()
    read = lambda k: np.frombuffer(b"".join(x for x, i in zip(raw, kind, strict=True) if i == k), RECORD)
    r, new = _firsts(read(NAMED))
    first = r[new]
    run = np.cumsum(np.concatenate(([True], first["h"][1:] != first["h"][:-1]))) - 1 if len(first) else np.zeros(0, np.int64)
    size = np.bincount(run)[run] if len(run) else run
    is_hot = np.isin(first["h"], hot)
    spread = (size > wide) | is_hot
    parts = [(np.concatenate((read(COVERED), r[~new])), COVERED), (first[(size > 1) & ~spread], NAMED), (first[spread], SPREAD)]
    cols = [_by_document(x, k) for x, k in parts if len(x)]
    names = ["doc", "kind", "payload"]
    kinds = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
    return pa.concat_tables([pa.table(dict(zip(names, c, strict=True)), kinds) for c in cols]) if cols else kinds.empty_table()


def _gather(routed: DataFrame, hot: np.ndarray) -> DataFrame:
    return routed.groupBy("bucket").applyInArrow(lambda g: _meet(g, hot, WIDE), FOUND)


def _bytes_again(batches, length, buckets):
    """For each document its named contexts with their bytes, and its spread windows as records of one window."""
    for batch in batches:
        columns = [batch.column(c) for c in ("doc", "text", "named", "spread")]
        for row in range(batch.num_rows):
            doc, text, named, spread = (c[row].as_py() for c in columns)
            raw = (text or "").encode()
            if named:
                r = np.frombuffer(b"".join(named), RECORD)
                n = len(r)
                yield [pa.array((mix(r["h"]) % _U(buckets)).astype(np.int32)), pa.array([NAMED] * n, pa.int32()), pa.array(r["h"].view(np.int64)), pa.array([doc] * n, pa.int64()),
                       pa.array(r["lo"]), pa.array([raw[a:b + length] for a, b in zip(r["lo"].tolist(), r["hi"].tolist(), strict=True)], pa.binary())]
            if spread:
                r = np.frombuffer(b"".join(spread), RECORD)
                at = np.unique(expand(r["lo"].astype(np.int64), (r["hi"] - r["lo"] + 1).astype(np.int64)))
                for base in range(0, int(at[-1]) + 1, SEGMENT):
                    mine = at[(at >= base) & (at < base + SEGMENT)]
                    if not len(mine):
                        continue
                    data = np.frombuffer(raw[base:base + SEGMENT + length], np.uint8)
                    c, (_, down) = prefix_hashes(data), powers(len(data) + 1)
                    h = mix((c[mine - base + length] - c[mine - base]) * down[mine - base])
                    w = np.zeros(len(mine), RECORD)
                    w["h"], w["c"], w["doc"], w["lo"], w["hi"] = h, (mix(h + _U(1)) >> _U(32)).astype(np.uint32), doc, mine, mine
                    w, new = _firsts(w)
                    for part, k in ((w[new], SPREAD), (w[~new], COVERED)):
                        bucket, _, blob = _packed(part, buckets, k, np.zeros(0, np.uint64))
                        m = len(bucket)
                        yield [bucket, pa.array([k] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), blob]


def _sorted_windows(doc: np.ndarray, lo: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """Covered windows among whole contexts, by suffix array and adjacent common prefixes."""
    text, starts = join(strings)
    order = suffix_array(text, starts)
    prefix = common_prefixes(text, starts, order, length)
    owner = np.repeat(np.arange(len(strings)), np.diff(np.append(starts, len(text))))[order]
    place = np.zeros(len(order), RECORD)
    place["doc"], place["lo"] = doc[owner], lo[owner] + order - starts[owner]
    place["hi"] = place["lo"]
    run = np.cumsum(prefix < length)
    linked = np.bincount(run)[run] > 1
    place, run = place[linked], run[linked]
    o = np.lexsort((place["lo"], place["doc"], run))
    place, run = place[o], run[o]
    later = np.zeros(len(run), bool)
    later[1:] = run[1:] == run[:-1]
    return place[later]


def _sort_group(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """One bucket of contexts, a few anchors at a time."""
    group = group.sort_values(["h", "doc", "lo"])
    h, doc, lo, strings = group["h"].to_numpy(), group["doc"].to_numpy(np.int64), group["lo"].to_numpy(np.int64), group["payload"].tolist()
    size = np.cumsum([len(s) for s in strings])
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    found, a = [], 0
    while a < len(h):
        most = np.searchsorted(size, (size[a - 1] if a else 0) + SORT_BYTES, "right")
        ends = new[(new > a) & (new <= most)]
        b = int(ends[-1]) if len(ends) else int(new[new > a][0])
        if b - a > 1:
            found.append(_sorted_windows(doc[a:b], lo[a:b], strings[a:b], length))
        a = b
    if not found:
        return pd.DataFrame({"doc": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype="int32"), "payload": []})
    doc, kind, payload = _by_document(np.concatenate(found), COVERED)
    return pd.DataFrame({"doc": doc.to_numpy(), "kind": kind.to_numpy(), "payload": payload.to_pylist()})


def _apply(batches, length, texts):
    for batch in batches:
        payloads, rows = batch.column("payload").to_pylist(), [[] for _ in range(9)]
        for i, text in enumerate(batch.column("text").to_pylist()):
            raw = (text or "").encode()
            ranges: list[int] = []
            if payloads[i]:
                r = np.frombuffer(b"".join(payloads[i]), RECORD)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, r["lo"], 1)
                np.add.at(edge, r["hi"] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                flips = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                ranges = flips.tolist()
            kept, at = [], 0
            for s, e in zip(ranges[0::2], ranges[1::2], strict=True):
                kept.append(raw[at:s])
                at = e
            left = b"".join([*kept, raw[at:]])
            for column, v in zip(rows, (len(raw), len(raw) - len(left), len(ranges) // 2, ranges, hashlib.sha256(left).hexdigest(), left if texts else None), strict=False):
                column.append(v)
        yield [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64())),
               pa.array(rows[4]), *([pa.array(rows[5], pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in rows[5]], pa.string()), batch.column("text"), batch.column("carried")] if texts else [])]


def _hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors that a sample of about SAMPLE documents shows in one of a hundred documents or more."""
    step = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc"), F.lit(step)) == 0)

    def anchors(batches):
        for batch in batches:
            for r in _records(batch, length):
                pairs = np.unique(r[["h", "doc"]])
                yield [pa.array(pairs["h"].view(np.int64) if len(pairs) else np.zeros(0, np.int64))]

    counts = in_arrow(sample, anchors, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return np.array([r[0] for r in counts.where(F.col("n") >= SAMPLE // 100).select("h").collect()], np.int64).view(np.uint64)


def covered_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, payloads) of every document with windows that also start earlier; docs has unique doc and text."""
    buckets = 4 * task_count(docs.sparkSession)
    hot = _hot_anchors(docs, length)
    routed = in_arrow(docs, lambda b: _route(b, length, buckets, hot), ROUTED)
    met = materialise(_gather(routed, hot), "anchors")
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("payload")))
    asked = met.where(F.col("kind") != COVERED).groupBy("doc").agg(of(NAMED).alias("named"), of(SPREAD).alias("spread"))  # a text is read once
    again = asked.join(docs, "doc").select("doc", "text", "named", "spread")
    kind = "bucket int, kind int, h bigint, doc bigint, lo int, payload binary"
    rows = materialise(in_arrow(again, lambda b: _bytes_again(b, length, buckets), kind), "contexts")
    named = rows.where(F.col("kind") == NAMED).groupBy("bucket").applyInPandas(lambda g: _sort_group(g, length), FOUND)
    nothing = np.zeros(0, np.uint64)
    single = rows.where(F.col("kind") != NAMED).select("bucket", F.when(F.col("kind") == SPREAD, NAMED).otherwise(COVERED).cast("int").alias("kind"), "payload")
    found = met.where(F.col("kind") == COVERED).union(named).union(_gather(single, nothing).where(F.col("kind") == COVERED))
    return found.groupBy("doc").agg(F.collect_list("payload").alias("payload"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, ranges (removed byte ranges, flat), kept_sha256 of every row.

    With `texts` also kept (remaining bytes), kept_text (its whole characters), text and carried (the other columns).
    """
    rest = [carried(docs, doc_id, text)] if texts else []
    base = even(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), *rest), "doc_id")
    used = base.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    base = base.withColumn("own", F.col("doc_id"))
    twice = materialise(docs.select(docs[doc_id].cast("bigint").alias("id")).where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"), "repeated")
    if twice.limit(1).count():
        mark = F.sha2(F.coalesce("text", F.lit("")), 256)
        least = used.join(twice.select(F.col("id").alias("doc")), "doc", "left_semi").groupBy(F.col("doc").alias("id")).agg(F.min(mark).alias("print"))
        least = materialise(least, "repeated")
        stay = F.col("id").isNull() | (mark == F.col("print"))
        met = used.join(least, used["doc"] == least["id"], "left").where(stay)
        used = met.where("id IS NULL").select("doc", "text").union(met.where("id IS NOT NULL").select("doc", "text").distinct())
        base = base.join(least, base["doc_id"] == least["id"], "left").withColumn("own", F.when(stay, F.col("doc_id"))).drop("id", "print")
    covered = covered_windows(used.where(F.octet_length("text") >= length), length)
    placed = base.join(covered.withColumnRenamed("doc", "own"), "own", "left").select("doc_id", "text", "payload", *["carried"] * texts)
    kind = fields("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, ranges array<bigint>, kept_sha256 string")
    if texts:
        kind = StructType([*kind.fields, *fields("kept binary, kept_text string, text string", base.schema["carried"]).fields])
    return in_arrow(placed, lambda b: _apply(b, length, texts), kind)


@query()
def op9_suffix_dedup(spark, d):
    """Every document without the bytes of 100-byte strings that also start earlier in the corpus."""
    return remove_repeats(table(spark, d, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
