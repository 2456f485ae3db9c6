"""Quality score of whole texts by a byte-level convolutional network in numpy.

Every text is padded and read by FILTERS learned filters of WIDTH bytes, one position every STRIDE bytes. Overlapping chunks
(CHUNK_BLOCKS blocks of BLOCK positions, one block shared with the next chunk) cover the whole text; each filter's activation
is max-pooled in a chunk, and the chunks' maxima are combined, as their mean and their maximum, into one logistic output. A
filter is an embedding of bytes times a kernel, so for scoring it is WIDTH tables of 256 + 1 rows: a position costs WIDTH
look-ups.

Training (Adam on the log loss, gradients through the pooled positions only) runs in one task over a bounded sample: at most
`per_label` labelled rows of each label, the first in hash order of their ids. A batch holds as many texts of either
label; the output is shifted from that to the labels' shares among all labelled rows.

Defined cases: a null text is empty; an empty text is one block of padding and gets a score like any other. Rows of labels
without id or label, or whose repetitions disagree, teach nothing. Without both labels every score is the share of label 1
(0.5 if there are none). A score depends on the text alone, to the last bit, whatever texts share its slice.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import slices
from .common import even, in_arrow, narrow, query, table

WIDTH, STRIDE, BLOCK, CHUNK_BLOCKS = 8, 4, 16, 4
EMBED, FILTERS = 8, 16
PER_LABEL = 1500
STEPS, BATCH, RATE, DECAY = 1000, 32, 0.01, 0.002
PAD = 256
CUT = 0.3


class Layout:
    """Texts of a slice as padded byte codes, positions, blocks and chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        span, lead = BLOCK * STRIDE, WIDTH - STRIDE  # a text begins behind padding, which is all that the last position of the text before reads
        size = np.diff(offsets)
        blocks = -(-(size + lead) // span)
        blocks = np.maximum(blocks, 1)
        starts = np.concatenate(([0], np.cumsum(blocks)))
        self.codes = np.full(int(starts[-1]) * span + WIDTH, PAD, np.int16)
        self.codes[np.arange(len(data)) + np.repeat(starts[:-1] * span + lead - offsets[:-1], size)] = data
        self.positions = int(starts[-1]) * BLOCK
        step = CHUNK_BLOCKS - 1
        chunks = np.maximum(1, -(-(blocks - CHUNK_BLOCKS) // step) + 1)
        self.chunk_starts = np.concatenate(([0], np.cumsum(chunks)))
        self.chunks = chunks
        k = np.arange(int(self.chunk_starts[-1])) - np.repeat(self.chunk_starts[:-1], chunks)
        first = np.repeat(starts[:-1], chunks) + k * step
        last = np.repeat(starts[1:], chunks) - 1
        self.members = np.minimum(first[:, None] + np.arange(CHUNK_BLOCKS), last[:, None])

    def activations(self, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = np.empty((self.positions, tables.shape[2]), np.float32)
        out[:] = bias
        term = np.empty_like(out)
        for j in range(WIDTH):
            np.take(tables[j], self.codes[j::STRIDE][:self.positions], axis=0, out=term)
            out += term
        return out


def tables_of(w: dict) -> np.ndarray:
    """(WIDTH, 257, FILTERS): what a byte at each place of a filter adds."""
    return np.einsum("be,jef->jbf", w["embed"], w["kernel"]).astype(np.float32)


def features(layout: Layout, tables: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: mean and maximum over chunks of every filter's pooled activation; the activations; the chunks' maxima."""
    z = layout.activations(tables, bias)
    pooled = np.maximum(z.reshape(-1, BLOCK, z.shape[1]).max(1)[layout.members].max(1), 0)
    at = layout.chunk_starts[:-1]
    mean = np.add.reduceat(pooled, at, axis=0) / layout.chunks[:, None]
    return np.concatenate((mean, np.maximum.reduceat(pooled, at, axis=0)), 1), z, pooled


def fit(texts: list[bytes], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    w = {"embed": rng.normal(0, 0.5, (PAD + 1, EMBED)), "kernel": rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)),
         "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1)}
    w["embed"][PAD] = 0
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    sides = [np.flatnonzero(labels == v) for v in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])  # both labels alike
        data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
        layout = Layout(data, np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick]))).astype(np.int64))
        x, z, pooled = features(layout, tables_of(w), w["bias"].astype(np.float32))
        p = 1 / (1 + np.exp(-np.clip(x @ w["out"] + w["shift"][0], -30, 30)))
        error = (p - labels[pick]) / len(pick)
        owner = np.repeat(np.arange(len(pick)), layout.chunks)
        grad = error[owner, None] * (w["out"][:FILTERS] / layout.chunks[owner, None])
        grad = grad + error[owner, None] * w["out"][FILTERS:] * (pooled == x[owner, FILTERS:])
        grad = np.where(pooled > 0, grad, 0)
        wide = z.reshape(-1, BLOCK, FILTERS)[layout.members].reshape(len(owner), -1, FILTERS)
        k = wide.argmax(1)
        at = np.take_along_axis(layout.members, k // BLOCK, 1) * BLOCK + k % BLOCK
        g = {"out": error @ x, "shift": np.array([error.sum()]), "bias": grad.sum(0), "embed": np.zeros_like(w["embed"]), "kernel": np.zeros_like(w["kernel"])}
        for j in range(WIDTH):
            code = layout.codes[at * STRIDE + j]
            g["kernel"][j] = np.einsum("cfe,cf->ef", w["embed"][code], grad)
            np.add.at(g["embed"], code.ravel(), (grad[:, :, None] * w["kernel"][j].T).reshape(-1, EMBED))
        g["embed"][PAD] = 0
        for name, v in g.items():
            v = v + DECAY * w[name]
            one[name] = 0.9 * one[name] + 0.1 * v
            two[name] = 0.999 * two[name] + 0.001 * v * v
            w[name] -= RATE * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)
    share = min(max(share, 1e-3), 1 - 1e-3)
    w["shift"] = w["shift"] + np.log(share / (1 - share))
    return w


def _fit_task(frame: pd.DataFrame, steps: int) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "label"])
    labels = frame["label"].to_numpy(np.float64)
    share = float(frame["share"].iloc[0])
    if len(np.unique(labels)) < 2:
        return pd.DataFrame({"weights": pd.Series([], dtype=object)})
    out = io.BytesIO()
    np.savez(out, **fit([(t or "").encode() for t in frame["text"]], labels, share, steps))
    return pd.DataFrame({"weights": [out.getvalue()]})


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> dict:
    """Weights from labelled rows: docs (doc_id, text), labels (doc_id, label of 0 or 1)."""
    sure = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    sure = sure.where("label = other").select("doc_id", "label")
    n, ones = sure.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = ones / n if n else 0.5
    first = [sure.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    chosen = first[0].union(first[1])
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    made = rows.withColumn("share", F.lit(float(share))).groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: _fit_task(f, steps), "weights binary").first()
    if made is None:
        return {"constant": np.array(share)}
    with np.load(io.BytesIO(made[0])) as stored:
        return dict(stored)


def _score(batches, sent):
    w = sent.value
    tables = None if "constant" in w else tables_of(w)
    for batch in batches:
        for part, data, off in slices(batch, limit=1 << 20):
            if tables is None:
                score = np.full(part.num_rows, float(w["constant"]))
            else:
                x, _, _ = features(Layout(data, off), tables, w["bias"].astype(np.float32))
                score = 1 / (1 + np.exp(-np.clip((x * w["out"]).sum(1) + w["shift"][0], -30, 30)))  # row by row: the same in any slice
            yield [*[part.column(c) for c in part.schema.names], pa.array(score)]


def scored(docs: DataFrame, weights: dict, score: str = "score") -> DataFrame:
    """All columns of docs, which has `text`, and the score; an input column of the score's name is replaced."""
    base = docs.drop(score)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return in_arrow(base, lambda b: _score(b, sent), StructType([*base.schema.fields, StructField(score, DoubleType())]))


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def model(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier of `labels.quality`, learnt outside the held-out fifth."""
    known = narrow(labels, doc_id="doc_id", label="quality").where(_fold() != 0)
    return learn(narrow(docs, doc_id="doc_id", text="text"), known)


@query()
def op4_quality(spark, d):
    """Quality score of every document."""
    docs = table(spark, d, "documents")
    out = scored(even(narrow(docs, doc_id="doc_id", text="text"), "doc_id"), model(docs, table(spark, d, "labels")))
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
