"""Exact top-k search by block-at-a-time pruning over integer vectors.

A vector's components are the weights of its terms. Vectors are put in an order that keeps similar ones together (by the nearest
of some pivots, fitted on a bounded sample; it only affects speed), and consecutive ranges of BLOCK of them form blocks with
their largest and smallest weight per term. STRIPE consecutive blocks form a stripe.

1. Each stripe scores its own queries against itself: the k-th score found is a floor below which a query need not look.
2. Packs of at most PACK queries meet the summaries of bundles of stripes: the sum over terms of the larger of weight times
   maximum and weight times minimum bounds all scores of a stripe. A query goes to the stripes whose bound reaches its floor.
3. There it orders the blocks by the same bound, scores them one after the other through their forward index (the vectors of the
   block) and stops when the next bound falls below its k-th score so far. Bounds equal to it are still looked at, for ties.
4. The k best of every query and stripe are ranked.

A task holds one stripe and one pack; both are bounded, so no key and no group of copies can fill a task. All sums are exact:
in double precision while they stay below 2 ** 53, with Python's integers beyond.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; missing components
of a shorter vector are zeros; an empty vector scores 0 with everything. Rows that repeat an id are all candidates and, as
queries, each have their own ranks; only the row itself is left out. Equal scores are ordered by vec_id. A component beyond
64 bits counts as the largest such number; a score beyond them stops the job. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise, narrow, query, table, task_count

BLOCK, STRIPE, PACK, BUNDLE = 256, 32, 2048, 256
SAMPLE, PIVOTS = 8192, 128
SAFE = 2**53
INDEX = "stripe bigint, seats binary, ids binary, vectors binary, largest binary, smallest binary"
ASKED = "home bigint, seat bigint, id bigint, weights binary, floor bigint"
FOUND = "seat bigint, query_id bigint, vec_id bigint, score bigint"


def integers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """seat (unique), id and the components as floor(scale * x) of the rows that take part."""
    base = narrow(vectors, id=vec_id, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    base = base.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound)
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return base.select(F.monotonically_increasing_id().alias("seat"), F.col("id").cast("bigint").alias("id"), whole.alias("weights"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rows(data: bytes, width: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width) if width else np.zeros((len(data) // 8, 0))


def pivots(drawn: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A few rounds of Lloyd's algorithm over the sample."""
    centre = drawn[np.linspace(0, len(drawn) - 1, min(PIVOTS, len(drawn))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(drawn, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, drawn)
        n = np.bincount(near, minlength=len(centre))
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1) - 2 * (x @ centre.T)).argmin(1)


def _keyed(batches, centre: np.ndarray, width: int):
    """The pivot of every vector, its distance and the vector as bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column(2), width)
        near = _nearest(x, centre) if width else np.zeros(len(x), int)
        far = ((x - centre[near]) ** 2).sum(1) if width else np.zeros(len(x))
        x = x.astype("<f8")
        yield [pa.array(near.astype(np.int32)), pa.array(far), b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())]


def _index(batches, width: int):
    """Stripes of consecutive rows with the largest and smallest weights of their blocks."""
    held: list[tuple] = []

    def stripe(rows):
        seats, ids = (np.array([r[i] for r in rows], "<i8") for i in (0, 1))
        x = _rows(b"".join(r[2] for r in rows), width) if width else np.zeros((len(rows), 0))
        at = np.arange(0, len(rows), BLOCK)
        return [[int(seats[0])], [seats.tobytes()], [ids.tobytes()], [x.tobytes()], [np.maximum.reduceat(x, at).tobytes()], [np.minimum.reduceat(x, at).tobytes()]]

    for b in batches:
        held.extend(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
        while len(held) >= BLOCK * STRIPE:
            part, held = held[:BLOCK * STRIPE], held[BLOCK * STRIPE:]
            yield [pa.array(c, t) for c, t in zip(stripe(part), _TYPES, strict=True)]
    if held:
        yield [pa.array(c, t) for c, t in zip(stripe(held), _TYPES, strict=True)]


_TYPES = [pa.int64(), *[pa.binary()] * 5]


def bounds(asked: np.ndarray, largest: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For every query and block, the sum over terms of what the block's weights can add at most."""
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    return products(up, largest) + products(down, smallest)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < SAFE:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every owner, by score, then smaller id."""
    down = -np.unique(score, return_inverse=True)[1] if score.dtype == object else -score
    order = np.lexsort((ids, down, owner))
    o = owner[order]
    first = np.searchsorted(o, o, "left")
    return order[np.arange(len(o)) - first < k]


def search(asked: np.ndarray, own: np.ndarray, floors: np.ndarray, x: np.ndarray, seats: np.ndarray, ids: np.ndarray, largest: np.ndarray, smallest: np.ndarray, k: int):
    """(query, place in x, score) of the k best of every query that reach its floor, block by block in the order of the bounds."""
    reach = bounds(asked, largest, smallest)
    order = np.argsort(-reach, axis=1, kind="stable")
    limit = floors.astype(reach.dtype)
    live = np.arange(len(asked))
    owner, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, reach.dtype)
    for step in range(order.shape[1]):
        block = order[live, step]
        on = reach[live, block] >= limit[live]
        live, block = live[on], block[on]  # bounds only fall: a query that stops stays stopped
        if not len(live):
            break
        for b in np.unique(block):
            who = live[block == b]
            a = b * BLOCK
            s = products(asked[who], x[a:a + BLOCK])
            q, j = np.nonzero((s >= limit[who, None]) & (seats[None, a:a + BLOCK] != own[who, None]))
            owner, place, score = np.append(owner, who[q]), np.append(place, a + j), np.append(score, s[q, j])
        keep = best(owner, score, ids[place], k)
        owner, place, score = owner[keep], place[keep], score[keep]
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        full = last[last - np.searchsorted(owner, owner[last], "left") + 1 >= k]
        limit[owner[full]] = np.maximum(limit[owner[full]], score[full])
    return owner, place, score


def _longs(score: np.ndarray) -> np.ndarray:
    if len(score) and not -2**63 <= min(score.min(), 0) <= max(score.max(), 0) < 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return np.array([int(s) for s in score], np.int64) if score.dtype == object else score.astype(np.int64)


LOWEST = -2**63  # no floor


def _limits(floors) -> np.ndarray:
    return np.array([-math.inf if f == LOWEST else int(f) for f in floors], object)


def _floors(batches, width: int, k: int, asks):
    """Queries of every stripe with the k-th score they find in it; a query without k partners there has none."""
    for b in batches:
        for home, s, i, v, top, low in zip(*[c.to_pylist() for c in b.columns], strict=True):
            seats, ids, x = np.frombuffer(s, "<i8"), np.frombuffer(i, "<i8"), _rows(v, width) if width else np.zeros((len(s) // 8, 0))
            mine = np.flatnonzero(asks(ids))
            floor = np.full(len(mine), LOWEST, np.int64)
            if len(mine):
                owner, _, score = search(x[mine], seats[mine], _limits(floor), x, seats, ids, *_ends(top, low, len(seats), width), k)
                n = np.bincount(owner, minlength=len(mine))
                last = np.cumsum(n) - 1
                floor[n >= k] = _longs(score)[last[n >= k]]
            yield [pa.array([home] * len(mine), pa.int64()), pa.array(seats[mine]), pa.array(ids[mine]), pa.array([x[m].tobytes() for m in mine], pa.binary()), pa.array(floor)]


def _ends(top: bytes, low: bytes, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = -(-rows // BLOCK)
    return np.frombuffer(top, "<f8").reshape(n, width), np.frombuffer(low, "<f8").reshape(n, width)


def _reached(batches, width: int):
    """Of every pack and bundle the stripes a query has to look at."""
    for b in batches:
        for pack, asked, stripes, top, low in zip(*[c.to_pylist() for c in b.columns], strict=True):
            w = _rows(b"".join(a["weights"] for a in asked), width) if width else np.zeros((len(asked), 0))
            n = len(stripes)
            reach = bounds(w, np.frombuffer(b"".join(top), "<f8").reshape(n, width), np.frombuffer(b"".join(low), "<f8").reshape(n, width))
            q, s = np.nonzero(reach >= _limits(a["floor"] for a in asked).astype(reach.dtype)[:, None])
            for at in range(0, len(q), 10_000):
                some = [asked[i] for i in q[at:at + 10_000]]
                yield [pa.array([stripes[i] for i in s[at:at + 10_000]], pa.int64()), pa.array([pack] * len(some), pa.int64()), *[pa.array([a[c] for a in some], t) for c, t in (("seat", pa.int64()), ("id", pa.int64()), ("weights", pa.binary()), ("floor", pa.int64()))]]


def _scan(stripe: pd.DataFrame, asked: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """One stripe and the queries of one pack that reach it."""
    if not len(stripe) or not len(asked):
        return pd.DataFrame({"seat": [], "query_id": [], "vec_id": [], "score": []}).astype(np.int64)
    r = stripe.iloc[0]
    seats, ids = np.frombuffer(r["seats"], "<i8"), np.frombuffer(r["ids"], "<i8")
    x = _rows(r["vectors"], width) if width else np.zeros((len(seats), 0))
    w = _rows(b"".join(asked["weights"]), width) if width else np.zeros((len(asked), 0))
    own, qid = asked["seat"].to_numpy(), asked["id"].to_numpy()
    owner, place, score = search(w, own, _limits(asked["floor"]), x, seats, ids, *_ends(r["largest"], r["smallest"], len(seats), width), k)
    return pd.DataFrame({"seat": own[owner], "query_id": qid[owner], "vec_id": ids[place], "score": _longs(score)})


def top_k(vectors: DataFrame, divisor: int, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best partners of every row whose id is divisible by `divisor`."""
    spark = vectors.sparkSession
    rows = materialise(integers(vectors, vec_id, vector, scale), "integers")
    width = rows.agg(F.max(F.size("weights"))).first()[0] or 0
    drawn = rows.orderBy(F.xxhash64("id"), "id", "seat").limit(SAMPLE).select("weights").toArrow().column(0).combine_chunks()
    centre = pivots(_matrix(drawn, width)) if len(drawn) and width else np.zeros((1, width))
    keyed = in_arrow(rows, partial(_keyed, centre=centre, width=width), "pivot int, far double, seat bigint, id bigint, vector binary")
    parts = max(1, min(4 * task_count(spark), math.ceil(rows.count() / (BLOCK * STRIPE))))
    ranged = materialise(keyed, "keyed").repartitionByRange(parts, "pivot", "far", "seat").sortWithinPartitions("pivot", "far", "seat")
    index = materialise(in_arrow(ranged, partial(_index, width=width), INDEX), "index")
    asked = materialise(in_arrow(index, partial(_floors, width=width, k=k, asks=lambda ids: ids % divisor == 0), ASKED), "asked")
    # summaries: the ends of a whole stripe, in bundles
    ends = in_arrow(index.select("stripe", "seats", "largest", "smallest"), partial(_stripe_ends, width=width), "stripe bigint, largest binary, smallest binary")
    bundles = max(1, math.ceil(index.count() / BUNDLE))
    bundle = F.pmod(F.xxhash64("stripe"), F.lit(bundles))
    summaries = ends.groupBy(bundle.alias("bundle")).agg(F.collect_list(F.struct("stripe", "largest", "smallest")).alias("ends"))
    packs = max(1, math.ceil(asked.count() / (PACK // 2)))
    packed = asked.groupBy(F.pmod(F.xxhash64("seat"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("seat", "id", "weights", "floor")).alias("asked"))
    meets = packed.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)).cast("array<bigint>"))).join(summaries, "bundle")
    meets = meets.select("pack", "asked", F.transform("ends", lambda e: e["stripe"]).alias("stripes"), F.transform("ends", lambda e: e["largest"]).alias("top"), F.transform("ends", lambda e: e["smallest"]).alias("low"))
    units = materialise(in_arrow(meets, partial(_reached, width=width), "stripe bigint, pack bigint, seat bigint, id bigint, weights binary, floor bigint"), "units")
    pairs = units.select(F.col("stripe").alias("at"), F.col("pack").alias("to")).distinct()
    sent = index.join(pairs, index["stripe"] == pairs["at"])
    found = sent.groupBy("at", "to").cogroup(units.groupBy("stripe", "pack")).applyInPandas(lambda s, a: _scan(s, a, width, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("seat").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stripe_ends(batches, width: int):
    for b in batches:
        for stripe, seats, top, low in zip(*[c.to_pylist() for c in b.columns], strict=True):
            largest, smallest = _ends(top, low, len(seats) // 8, width)
            yield [pa.array([stripe], pa.int64()), pa.array([largest.max(0).tobytes()], pa.binary()), pa.array([smallest.min(0).tobytes()], pa.binary())]


_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256*x)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x,v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id<>v.vec_id WHERE q.vec_id%50=0)
QUALIFY rank<=5"""


@query(_SQL)
def op13_top_k(spark, d):
    """The 5 highest integer inner products of every fiftieth vector with all others."""
    return top_k(table(spark, d, "embeddings"), 50, 5)
