"""Nearest neighbours by largest inner product: inverted lists scanned with adaptive dimensions.

* Inner product becomes distance by one more component, sqrt(M*M - |x|*|x|) with M the largest norm (0 for a query).
* A random rotation makes any leading components of a vector a fair sample of it; vectors are kept in blocks of one list, the
  rotated components in column blocks of COLUMNS.
* A task scans one block for up to QUERIES queries. The first column block is one matrix product for all pairs. The candidates
  nearest by it give each query a bound, the k-th of their exact distances. Every other pair goes on from column block to column
  block only while the hypothesis that its whole distance lies below the bound stands: partial * D / d <= bound * (1 + E/sqrt(d))^2.
* Survivors are scored by the inner product of the original vectors in double precision.

Equal vectors are indexed once: one representative with the k + 1 smallest of its ids, which are all that can be among the k
nearest of any query, so exact ties between copies go to the smaller ids. Distances are kept in single precision; no pair is
dropped for a difference within the rounding of that (`MARGIN`).

Rotation, centroids and the number of probed lists are fitted on a bounded sample (`sample` vectors, the first in hash order):
lists are probed until TARGET of the sample's own neighbours are found, so evenly spread vectors need many lists and clustered
ones few. All vectors are indexed. A list of any size is cut into blocks, so one hot list is many tasks.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part,
neither do rows without id. Every row with the query's id is the query's own. Rows that repeat an id are one candidate with
its best score. Fewer candidates than k: all of them, if their lists are probed; lists are added until 10 k vectors are met.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import expand
from .common import in_arrow, materialise, narrow, query, table

COLUMNS = 16
VECTORS = 2048
QUERIES = 512
LISTS = 4096
SAMPLE = 65536
TARGET = 0.96
EPSILON = 2.1
LEADERS = 8  # times k vectors, the nearest by the first column block, give the bound
DENSE = 0.05
MARGIN = 32 * float(np.finfo(np.float32).eps)  # times |q|*|q| + |x|*|x|: rounding of a distance of any column blocks
ROUNDS = 10


def usable(df: DataFrame, vec_id: str, vector: str, dimension: int | None = None) -> tuple[DataFrame, int]:
    """id, vec of all vectors that take part, and their length (the most frequent one unless given)."""
    rows = narrow(df, id=vec_id, vec=vector).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)
    if dimension is None:
        first = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dimension = first[0] if first else 0
    return rows.where(F.size("vec") == dimension), dimension


def distinct(base: DataFrame, k: int) -> DataFrame:
    """id, ids, vec of all different vectors: the smallest of a vector's ids, and its k + 1 smallest.

    Repeated rows are dropped first; the limit of the window holds before the rows meet by vector, so copies by the million
    are k + 1 rows of a task.
    """
    rows = base.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct()  # -0.0 is 0.0
    rows = rows.select("id", "vec", F.xxhash64("vec").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("hash", "vec").orderBy("id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ids = F.array_sort(F.collect_list("id"))
    return least.groupBy("hash", "vec").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("id"), "ids", "vec")


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension)


class Model:
    """Rotation, centroids and probing, fitted on a sample."""

    def __init__(self, sample: np.ndarray, norm2: float, total: int, k: int, lists: int | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.norm2 = norm2
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
        x = self.lift(sample)
        n = min(len(x), lists or max(1, min(LISTS, round(math.sqrt(total) / 4))))
        c = x[rng.choice(len(x), n, replace=False)].copy()
        for _ in range(ROUNDS):
            near = self.order(x, c, 1)[:, 0]
            size = np.bincount(near, minlength=n)
            by = np.argsort(near, kind="stable")
            full = np.flatnonzero(size)
            sums = np.add.reduceat(x[by], (np.cumsum(size) - size)[full], axis=0)
            c[full] = sums / size[full][:, None]
        self.centroids = c
        self.probes = self._probes(sample[:4096], k)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return (np.concatenate((x, rest[:, None]), 1).astype(np.float32)) @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32) @ self.rotation

    @staticmethod
    def order(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of every row, nearest first."""
        out = []
        for a in range(0, len(x), 4096):
            gap = (c * c).sum(1) - 2 * x[a:a + 4096] @ c.T
            out.append(np.argsort(gap, 1, kind="stable")[:, :n] if n > 1 else gap.argmin(1)[:, None])
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)

    def _probes(self, sample: np.ndarray, k: int) -> int:
        """Lists to probe so that TARGET of the sample's neighbours within the sample are met."""
        n = len(self.centroids)
        q = sample[:: max(1, len(sample) // 256)]
        if n == 1 or len(sample) <= k + 1:
            return n
        score = q @ sample.T
        score[score >= (q * q).sum(1)[:, None] - 1e-9] = -np.inf  # the query itself and its copies
        best = np.argpartition(-score, k, 1)[:, :k]
        home = self.order(self.lift(sample), self.centroids, 1)[:, 0]
        rank = np.argsort(self.order(self.turn(q), self.centroids, n), 1)
        met = np.sort(np.take_along_axis(rank, home[best], 1).ravel())
        return int(met[min(len(met) - 1, math.ceil(TARGET * len(met)))]) + 1

    def enough(self, sizes: np.ndarray, least: int) -> int:
        """Probes after which any query has met `least` vectors."""
        return max(self.probes, int(np.searchsorted(np.cumsum(np.sort(sizes)), min(least, sizes.sum()))) + 1)


def scan(q: np.ndarray, x: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the k nearest of the block; x is the list of column blocks.

    While many pairs stand a column block is one matrix product, after that it is read for the standing pairs alone.
    """
    n, d = len(x[0]), q.shape[1]
    edge = np.concatenate(([0], np.cumsum([b.shape[1] for b in x])))

    def whole(b: int) -> np.ndarray:
        mine = q[:, edge[b]:edge[b + 1]]
        return (mine * mine).sum(1)[:, None] + (x[b] * x[b]).sum(1) - 2 * mine @ x[b].T

    def part(b: int, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
        diff = q[qi, edge[b]:edge[b + 1]] - x[b][xi]
        return np.einsum("ij,ij->i", diff, diff)

    if n <= LEADERS * k or len(x) == 1:
        qi = np.repeat(np.arange(len(q)), n)
        return qi, np.tile(np.arange(n), len(q))
    near = np.maximum(whole(0), 0)
    first = np.argpartition(near, LEADERS * k - 1, 1)[:, :LEADERS * k]
    qi, xi = np.repeat(np.arange(len(q)), LEADERS * k), first.ravel()
    full = near[qi, xi] + sum(part(b, qi, xi) for b in range(1, len(x)))
    best = np.argpartition(full.reshape(len(q), -1), k - 1, 1)[:, :k]
    bound = np.take_along_axis(full.reshape(len(q), -1), best, 1).max(1) * (1 + 1e-5)
    slack = MARGIN * ((q * q).sum(1) + sum((b * b).sum(1) for b in x).max())
    own = np.take_along_axis(first, best, 1).ravel()
    limit = lambda seen: (1 + EPSILON / math.sqrt(seen)) ** 2 * seen / d if seen < d else 1
    standing, pairs = near <= (bound * limit(edge[1]) + slack)[:, None], None
    for b in range(1, len(x)):
        if pairs is None and standing.mean() > DENSE:
            near += whole(b)
            standing &= near <= (bound * limit(edge[b + 1]) + slack)[:, None]
            continue
        if pairs is None:
            qi, xi = np.nonzero(standing)
            pairs = near[qi, xi]
        pairs = pairs + part(b, qi, xi)
        keep = pairs <= bound[qi] * limit(edge[b + 1]) + slack[qi]
        qi, xi, pairs = qi[keep], xi[keep], pairs[keep]
    if pairs is None:
        qi, xi = np.nonzero(standing)
    return np.concatenate((qi, np.repeat(np.arange(len(q)), k))), np.concatenate((xi, own))  # rounding may not lose the bound's own


def _top(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, held: np.ndarray, v: np.ndarray, qi: np.ndarray, xi: np.ndarray, k: int):
    """The k best of each query by the original vectors, best first, ties to the smaller id; vector i holds held[i] of the ids."""
    pair = np.unique(qi * len(v) + xi)
    qi, xi = pair // len(v), pair % len(v)
    score = np.einsum("ij,ij->i", q[qi], v[xi])
    n = held[xi]
    found = vid[expand((np.cumsum(held) - held)[xi], n)]
    qi, score = np.repeat(qi, n), np.repeat(score, n)
    other = qid[qi] != found
    qi, found, score = qi[other], found[other], score[other]
    order = np.lexsort((found, -score, qi))
    qi, found, score = qi[order], found[order], score[order]
    start = np.searchsorted(qi, np.arange(len(qid)))
    keep = np.arange(len(qi)) - start[qi] < k
    return qid[qi[keep]], found[keep], score[keep]


def _assign(batches, sent, dimension, probes):
    m = sent.value
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            x = _matrix(part.column("vec"), dimension)
            near = m.order(m.turn(x) if probes else m.lift(x), m.centroids, probes or 1)
            raw = [r.tobytes() for r in x]
            ids = np.repeat(part.column("id").to_numpy(), near.shape[1])
            kept = [np.array(i, np.int64).tobytes() for i in part.column("ids").to_pylist()]
            again = lambda values: pa.array([r for r in values for _ in range(near.shape[1])], pa.binary())
            yield [pa.array(near.ravel().astype(np.int32)), pa.array(ids), again(kept), again(raw)]


def _pack(frame: pd.DataFrame, sent, dimension: int, rotated: bool) -> pd.DataFrame:
    frame = frame.sort_values("id")
    x = np.frombuffer(b"".join(frame["vec"]), np.float64).reshape(-1, dimension)
    columns: list[bytes] = []
    if rotated:
        y = sent.value.lift(x)
        columns = [np.ascontiguousarray(y[:, a:a + COLUMNS]).tobytes() for a in range(0, y.shape[1], COLUMNS)]
    held = np.array([len(i) // 8 for i in frame["ids"]], np.int64)
    return pd.DataFrame({"list": [frame["list"].iloc[0]], "ids": [b"".join(frame["ids"])], "held": [held.tobytes()], "vecs": [x.tobytes()], "columns": [columns]})


def _search(batches, sent, dimension, k):
    m = sent.value
    for batch in batches:
        for row in batch.to_pylist():
            vid, held, qid = (np.frombuffer(row[c], np.int64) for c in ("ids", "held", "query_ids"))
            v = np.frombuffer(row["vecs"], np.float64).reshape(-1, dimension)
            q = np.frombuffer(row["query_vecs"], np.float64).reshape(-1, dimension)
            x = [np.frombuffer(c, np.float32).reshape(len(v), -1) for c in row["columns"]]
            a, b, s = _top(qid, q, vid, held, v, *scan(m.turn(q), x, k + 1), k)
            yield [pa.array(a), pa.array(b), pa.array(s)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", lists: int | None = None,
            sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every query; queries has the columns of vectors."""
    spark = vectors.sparkSession
    found = "query_id bigint, vec_id bigint, score double"
    base, dimension = usable(vectors, vec_id, vector)
    total, norm2 = base.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = min(sample, max(4096, 16 * round(math.sqrt(total) / 4)))
    chosen = base.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toArrow()
    drawn = _matrix(chosen.column("vec").combine_chunks(), dimension)
    drawn = drawn[np.sort(np.unique(drawn, axis=0, return_index=True)[1])]  # copies say nothing about the lists
    model = Model(drawn, norm2, total, k, lists)
    sent = spark.sparkContext.broadcast(model)
    home = "list int, id bigint, ids binary, vec binary"
    homes = materialise(in_arrow(distinct(base, k), lambda b: _assign(b, sent, dimension, 0), home), "homes")
    counts = homes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    sizes = np.zeros(len(model.centroids), np.int64)
    for at, n in counts.collect():  # one row per list, LISTS at most
        sizes[at] = n
    probes = min(len(sizes), model.enough(sizes, 10 * k))
    kind = "list int, ids binary, held binary, vecs binary, columns array<binary>"
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / VECTORS))
    blocks = homes.join(F.broadcast(counts), "list").groupBy("list", block.alias("block")).applyInPandas(lambda f: _pack(f, sent, dimension, True), kind)
    asked, _ = usable(queries, vec_id, vector, dimension)
    asked = materialise(asked, "queries")
    chunks = max(1, math.ceil(asked.count() * probes / len(sizes) / QUERIES))
    probed = in_arrow(asked.withColumn("ids", F.array("id")), lambda b: _assign(b, sent, dimension, probes), home)
    packs = probed.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).applyInPandas(lambda f: _pack(f, sent, dimension, False), kind)
    units = blocks.join(packs.select("list", F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs")), "list").drop("list")
    pairs = in_arrow(units, lambda b: _search(b, sent, dimension, k), found)
    single = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op1_nearest(spark, d):
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, d, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
