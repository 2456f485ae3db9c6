"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points in lower case, everything but letters counting as one sign. The n-grams of one to three characters
of a text fall into BUCKETS hash buckets. Counts per language and bucket are summed in every task and then by Spark over all
learning rows; the log-probability matrix (languages times BUCKETS, bounded by MAX_LANGUAGES) is broadcast. A task scores a
slice of texts at once: the bucket of every n-gram picks a row of the matrix, and the rows are summed text by text.

Defined cases: `und` with score 0 for a null text, one without letters, or when nothing could be learnt. A row without text,
language or id teaches nothing. The score is the posterior probability of the predicted language; of languages with equal
posteriors the first by code points is predicted.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, slices
from .common import even, in_arrow, materialise, narrow, query, table
from .pieces import LETTER, code_points, tables

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
MAX_LANGUAGES = 1000
SMOOTHING = 0.1
UNKNOWN = "und"
_U = np.uint64
_SIGNS: list[np.ndarray] = []


def signs() -> np.ndarray:
    """A random value per code point, equal for both cases of a letter and for all that are no letters."""
    if not _SIGNS:
        kind, value = tables()
        low = np.arange(sys.maxunicode + 1)
        for c in np.flatnonzero(kind == LETTER).tolist():
            s = chr(c).lower()
            if len(s) == 1:
                low[c] = ord(s)
        low[kind != LETTER] = 32
        _SIGNS.append(value[low])
    return _SIGNS[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram length: buckets and the rows' offsets into them; and whether a row has letters."""
    _, cps, rows = code_points(data, offsets)
    n = len(rows) - 1
    letter = np.concatenate(([0], np.cumsum(tables()[0][cps] == LETTER)))
    value = signs()[cps]
    out, h = [], np.zeros(len(cps), np.uint64)
    for order in range(1, ORDERS + 1):
        size = len(cps) - order + 1
        h = h[:max(size, 0)] * _U(0xD6E8FEB86659FD93) + value[order - 1:]
        bucket = ((mix(h) if order > 1 else h) >> _U(64 - BITS)).astype(np.int32)
        count = np.maximum(np.diff(rows) - order + 1, 0)
        inside = np.ones(len(bucket), bool)
        for back in range(1, order):  # an n-gram that starts this close to its row's end would leave the row
            p = rows[1:] - back
            inside[p[(p >= rows[:-1]) & (p < len(bucket))]] = False
        out.append((bucket[inside], np.concatenate(([0], np.cumsum(count)))))
    return out, np.diff(letter[rows]) > 0 if n else np.zeros(0, bool)


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part, data, off in slices(batch):
            names, where = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            found, _ = grams(data, off)
            for bucket, at in found:
                lang = np.repeat(where, np.diff(at))
                counted = np.bincount(lang * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, c in zip(names.tolist(), counted, strict=True):
                    total[name] = total.get(name, 0) + c
            for name, k in zip(names.tolist(), np.bincount(where, minlength=len(names)).tolist(), strict=True):
                docs[name] = docs.get(name, 0) + k
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], docs[name]))]


def _column(table: pa.Table) -> pa.Table:
    """One language's documents and its column of the matrix, of at most BUCKETS + 1 counts."""
    dense = np.zeros(BUCKETS + 1)
    dense[table.column("bucket").to_numpy()] = table.column("n").to_numpy()  # bucket -1, the last place: documents
    seen = dense[:-1] + SMOOTHING
    return pa.table({"lang": table.column("lang").slice(0, 1), "docs": pa.array(dense[-1:]), "logs": pa.array([np.log(seen / seen.sum()).astype(np.float32)], pa.list_(pa.float32()))})


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix (BUCKETS, languages) from rows with text and lang.

    The driver gets one array per language, in Arrow, after their number has been checked.
    """
    usable = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sums = materialise(in_arrow(usable, _counts, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    if sums.where("bucket = -1").limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    made = sums.groupBy("lang").applyInArrow(_column, "lang string, docs double, logs array<float>").toArrow()
    names, docs = made.column("lang").to_pylist(), made.column("docs").to_numpy()
    order = sorted(range(len(names)), key=names.__getitem__)
    logs = made.column("logs").combine_chunks()
    flat = logs.flatten().to_numpy() if len(names) else np.zeros(0, np.float32)
    return [names[i] for i in order], np.log(docs[order] / max(docs.sum(), 1)), np.ascontiguousarray(flat.reshape(-1, BUCKETS)[order].T)


def _score(batches, model):
    names, prior, matrix = model.value
    for batch in batches:
        for part, data, off in slices(batch):
            found, letters = grams(data, off)
            n = part.num_rows
            best, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if names:
                total = np.tile(prior, (n, 1))
                for bucket, at in found:
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        total[full] += np.add.reduceat(matrix[bucket], at[full], axis=0, dtype=np.float64)
                total -= total.max(1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(1, keepdims=True)
                best[letters] = np.array(names, object)[p.argmax(1)][letters]
                score[letters] = p.max(1)[letters]
            yield [part.column("doc_id"), pa.array(best.tolist(), pa.string()), pa.array(score)]


def identify(docs: DataFrame, model: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double"
    return in_arrow(even(narrow(docs, doc_id=doc_id, text=text), "doc_id"), lambda b: _score(b, sent), kind)


def _fold(column: str, of: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(of))


@query()
def op3_language(spark, d):
    """The language of every document, learnt from the documents outside the held-out quarter."""
    docs = table(spark, d, "documents")
    model = learn(even(narrow(docs, doc_id="doc_id", text="text", lang="lang").where(_fold("doc_id", 4) != 2), "doc_id"))
    return identify(docs, model).select("doc_id", F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
