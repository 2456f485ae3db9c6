"""Near duplicates by bottom-k sketches of one hash function.

1. Every text becomes its set of word shingles; texts with equal sets form a class, of which the smallest id goes on.
2. The sketch of a set is its `KEEP` smallest hashes. Two sets of similarity J share about J * KEEP of them; `_share` is six
   standard deviations below that (all of them for sets no larger than a sketch), so a pair at the threshold is missed with a
   probability of about 1e-8. A value that only one sketch holds cannot be shared; a document with fewer shared values than
   `_share` has no partner.
3. Inverted lists hold the rarest shared values of each document, as many as any partner must hit once (prefix filter). The
   smallest document of a list is its hub; a cluster is a hub with all documents of its lists. No pairs are emitted: the rows
   are (hub, document), at most one per retained value.
4. A cluster is cut into blocks of at most BLOCK documents. A block's task compares its documents of different components:
   sketches first (union-sketch estimate), then the full sets (exact Jaccard). It emits only links that join components.
5. A cluster of several blocks needs one more pass: documents outside the cluster's largest component meet every block. After
   it every pair of a list is either in one component or compared.

Defined cases: a null or empty text, or one of white space only, has the empty set and is its own component. A row without id
is linked with nothing and has no component. Rows that repeat an id are one document whose links are those of all its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even, in_arrow, materialise, narrow, query, table, task_count
from .graph import components
from .shingles import full_sets, profile

KEEP = 48
BLOCK = 400
CHUNK = 1200
COLUMNS = 4096
PAIRS = 20_000


def _share(percent: int) -> int:
    """Sketch values two sets of the given similarity share at least, but for a chance of about 1e-8."""
    j = percent / 100
    return math.floor(KEEP * j - 6 * math.sqrt(KEEP * j * (1 - j)))


def _estimates(heads: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that the sketches of pairs share within the bottom-k sketch of their union, less those a union of fewer values lacks."""
    top = np.uint64(2**64 - 1)
    wide = np.full((len(heads), KEEP), top, np.uint64)
    for i, h in enumerate(heads):
        wide[i, :len(h)] = h
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        both = np.sort(np.concatenate((wide[a[at:at + PAIRS]], wide[b[at:at + PAIRS]]), 1), 1)
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
        rank = np.cumsum(~twice & (both != top), 1)
        out[at:at + PAIRS] = (twice & (rank <= KEEP)).sum(1) + np.maximum(0, KEEP - rank[:, -1])
    return out


def _overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left rows with right rows, by products of 0/1 columns."""
    size = np.array([len(r) for r in rows])
    _, column, held = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), size)
    keep = held[column] > 1
    shared = np.cumsum(held > 1) - 1
    column, owner = shared[column[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(rows), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[left] @ dense[right].T
    return out


class _Sets:
    """Union-find over local positions."""

    def __init__(self, names: np.ndarray):
        _, self.up = np.unique(names, return_inverse=True)

    def join(self, i: int, j: int) -> bool:
        a, b = self.up[i], self.up[j]
        if a == b:
            return False
        self.up[self.up == max(a, b)] = min(a, b)
        return True


def _links(sets: list[np.ndarray], names: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, share: int):
    """Position pairs whose exact similarity reaches the threshold and that join two components."""
    size = np.array([len(s) for s in sets])
    joined = _Sets(names)
    near = (100 * np.minimum(size[left][:, None], size[right]) >= percent * np.maximum(size[left][:, None], size[right]))
    near &= (joined.up[left][:, None] != joined.up[right]) & (left[:, None] != right)
    if not near.any():
        return []
    heads = [s[:KEEP] for s in sets]
    need = np.minimum(share, np.ceil(percent / 100 * size))
    near &= _overlaps(heads, left, right) >= np.minimum(need[left][:, None], need[right])
    i, j = np.nonzero(near)
    near[i, j] = _estimates(heads, left[i], right[j]) >= share
    rows, cols = near.any(1), near.any(0)
    if not rows.any():
        return []
    left, right, near = left[rows], right[cols], near[np.ix_(rows, cols)]
    both = _overlaps(sets, left, right)
    near &= 100 * both >= percent * (size[left][:, None] + size[right] - both)
    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = int(left[i]), int(right[j])
        if joined.join(a, b):
            out.append((a, b))
    return out


def _block(frame: pd.DataFrame, percent: int, share: int) -> pd.DataFrame:
    """Links found in one block: the hub and the block's documents, or a block and documents from elsewhere (`guest`)."""
    frame = frame.sort_values(["guest", "doc"], kind="stable").drop_duplicates(["doc", "shingles"])  # a guest at home is a host
    sets = [np.frombuffer(b, np.uint64) for b in frame["shingles"]]
    place = np.arange(len(frame))
    guest = frame["guest"].to_numpy()
    left, right = (place[~guest], place[guest]) if guest.any() else (place, place)
    found = _links(sets, frame["component"].to_numpy(), left, right, percent, share)
    doc = frame["doc"].to_numpy()
    return pd.DataFrame({"a": [doc[i] for i, _ in found], "b": [doc[j] for _, j in found]}, dtype="int64")


def _compare(members: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links within the groups of `members` (keys, doc, component, guest), one task group per key."""
    share = _share(percent)
    rows = members.join(sets, "doc").select(*keys, "doc", "component", "guest", "shingles")
    found = rows.groupBy(*keys).applyInPandas(lambda f: _block(f, percent, share), "a bigint, b bigint")
    return materialise(found.distinct(), "found")


def _clusters(reps: DataFrame, percent: int) -> DataFrame:
    """(hub, doc) for every document that shares one of its rarest sketch values with the hub, hubs included."""
    entries = reps.select("doc", "n", F.explode("sketch").alias("value"))
    held = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = entries.join(held, "value").groupBy("doc", "n").agg(F.collect_list(F.struct("df", "value")).alias("values"))
    need = F.least(F.lit(_share(percent)), F.ceil(F.col("n") * percent / 100)).cast("int")
    listed = shared.where(F.size("values") >= need).withColumn("values", F.slice(F.array_sort("values"), F.lit(1), F.size("values") - need + 1))
    lists = materialise(listed.select("doc", F.explode("values.value").alias("value")), "lists")
    hubs = lists.groupBy("value").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("last > hub").select("value", "hub")
    return materialise(lists.join(hubs, "value").select("hub", "doc").distinct(), "clusters")


def _salt(n):
    return F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), F.ceil(n / BLOCK)))


def _search(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links needed for the components of the documents in the clusters."""
    sizes = clusters.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    placed = materialise(clusters.join(sizes, "hub").withColumn("block", _salt(F.col("members"))), "placed")
    hubs = placed.select("hub", "block", "members").distinct().select("hub", F.col("hub").alias("doc"), "members", "block")
    first = placed.select("hub", "doc", "members", "block").union(hubs)
    alone = first.select("hub", "block", "doc", F.col("doc").alias("component"), F.lit(False).alias("guest"))
    links = _compare(alone, sets, ["hub", "block"], percent)
    large = placed.where(F.col("members") > BLOCK)
    if not large.limit(1).count():
        return links
    labels = components(links)
    named = large.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = materialise(named, "named")
    weights = named.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("k"))
    main = weights.groupBy("hub").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    main = main.where(F.col("all") > F.col("most")).withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / CHUNK))
    cut = named.join(main.select("hub", "main", "chunks"), "hub")
    hosts = cut.select("hub", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc", "component", F.lit(False).alias("guest"))
    blocks = cut.select("hub", "block").distinct()
    strays = cut.where(F.col("component") != F.col("main"))
    guests = strays.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "doc"), F.col("chunks"))).drop("block").join(blocks, "hub")
    guests = guests.select("hub", "block", "chunk", "doc", "component", F.lit(True).alias("guest"))
    return links.union(_compare(hosts.union(guests), sets, ["hub", "block", "chunk"], percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id), kept for every row.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    base = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kind = "doc bigint, n bigint, class binary, sketch array<bigint>"
    seen = materialise(in_arrow(even(base, "doc_id"), lambda b: profile(b, width, KEEP), kind), "sketches")
    usable = seen.where("n > 0 AND doc IS NOT NULL")
    classes = materialise(usable.groupBy("class").agg(F.min("doc").alias("doc")), "classes")  # written, so a large class is not dealt by its key below
    reps = usable.join(classes, ["class", "doc"]).select("doc", "n", "sketch")
    clusters = _clusters(reps, percent)
    texts = base.withColumnRenamed("doc_id", "doc").join(clusters.select("doc").distinct(), "doc", "left_semi")
    made = in_arrow(texts.withColumnRenamed("doc", "doc_id"), lambda b: full_sets(b, width), "doc bigint, shingles binary")
    sets = materialise(made, "sets")
    links = _search(clusters, sets, percent)
    repeated = usable.groupBy("doc").agg(F.min("class").alias("one"), F.max("class").alias("two")).where("one <> two").select("doc")
    same = usable.join(repeated, "doc", "left_semi").select("class", F.col("doc").alias("a")).join(classes, "class").select("a", F.col("doc").alias("b"))
    labels = components(links.union(same))
    named = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("class", F.coalesce("component", "doc").alias("component"))
    out = seen.select("doc", "n", "class").join(named, "class", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)>=3 THEN list_transform(range(1,len(w)-1), lambda i: array_to_string(w[i:i+2],' ')) WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g=b.g AND a.doc_id<>b.doc_id GROUP BY 1,2),
l AS (SELECT a,b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*k>=85*(x.n+y.n-k)),
r(a,b) AS (SELECT a,b FROM l UNION SELECT r.a,l.b FROM r JOIN l ON r.b=l.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n,0)::BIGINT AS n_shingles, least(w.doc_id,coalesce(m,w.doc_id)) AS component_id, w.doc_id<=coalesce(m,w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op2_near_duplicates(spark, d):
    """Components of documents whose three-word shingle sets overlap by 85 of 100 or more."""
    return near_duplicates(table(spark, d, "documents"), width=3, percent=85)
