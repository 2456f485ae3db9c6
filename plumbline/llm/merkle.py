"""Merkle manifest of a dataset: concatenated-level strings of aligned blocks, sibling segments and folding, all in SQL functions.

1. A leaf is the hash of a row's fields, each written as `-` if null, else byte count, `:`, value.
2. Rows are range-partitioned and sorted by (source, id); counts per partition and source give every leaf its place, so no
   source is sorted in one task.
3. An aligned block of FAN * FAN leaves of a source keeps each level as one hex string. A parent is the hash of a substring of
   FAN digests. Blocks leave one digest each, which are the leaves of the next round, until one is left: the subroot.
   Subroots, in the order of their sources, are the leaves of one more such tree; what is left there is the root.
4. From the top down, a digest's path is, per level, what flanks it in its run: the substrings left and right of it. A block
   hands its own path on to all its leaves. A proof is the hash of those segments, folding a leaf through them gives the root.

A block holds at most FAN * FAN digests whatever the size of a source. Paths of blocks are joined by (source, place), which is
one row each; paths of sources are joined with salts where a source is hot.

Defined cases: a null field is `-`, also a null id, which sorts first; rows that repeat an id are all leaves, in no defined
order among themselves unless their digests are equal; the null source is a source of its own and comes first; an empty table
has no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import attach, with_scalar
from .common import even, materialise, narrow, query, table, task_count

FAN, HEX = 16, 64  # fixed values: nodes under a parent, hex digits of a digest
WIDE = FAN * FAN
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _written(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    return digest(*[_written(c) for c in fields])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with `place`, from 0 in the order of their group, and the group's `size`; equal rows may take either place."""
    dealt = rows.repartitionByRange(task_count(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "part", before.alias("before"), F.sum("k").over(whole).alias("size"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return dealt.withColumn("place", inside).join(counts, [group, "part"]).withColumn("place", F.col("before") + F.col("place")).drop("before", "part")


def _above(level: str) -> Column:
    """The next level's string: every run of FAN digests hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * FAN * HEX + 1, F.lit(FAN * HEX)), 256)), "")


def _flanks(level: str, i: Column) -> Column:
    """What stands left and right of digest i in its run."""
    first = i - i % FAN
    last = F.least((first + FAN) * HEX, F.length(level))
    return F.struct(F.substring(level, first * HEX + 1, (i - first) * HEX).alias("left"), F.substring(level, (i + 1) * HEX + 1, last - (i + 1) * HEX).alias("right"))


def blocks(nodes: DataFrame, group: str, *kept: str) -> DataFrame:
    """Aligned blocks of nodes (group, place, size, node): group, block, size, level0, level1, top and the rows' other columns."""
    at = (F.col("place") / WIDE).cast("bigint")
    held = F.sort_array(F.collect_list(F.struct("place", "node", *kept)))
    out = nodes.withColumn("block", F.floor(at)).groupBy(group, "block").agg(F.max("size").alias("size"), held.alias("rows"))
    out = out.withColumn("level0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    out = out.withColumn("level1", F.when(F.col("size") > 1, _above("level0")).otherwise(F.lit("")))
    top = F.when(F.col("size") == 1, F.col("level0")).when(F.col("size") <= FAN, F.col("level1")).otherwise(F.sha2("level1", 256))
    return materialise(out.withColumn("top", top), "blocks")


def _paths(found: DataFrame, above: Column) -> Column:
    """Of every row of a block: its other columns and its path, the block's own path last."""
    def one(r, i):
        inner = F.array(_flanks("level0", i)), F.array(_flanks("level1", F.floor(i / FAN).cast("int")))
        own = F.when(F.col("size") == 1, F.slice(inner[0], 1, 0)).when(F.col("size") <= FAN, inner[0]).otherwise(F.concat(*inner))
        return F.struct(r.alias("row"), F.concat(own, above).alias("path"))
    return F.transform("rows", one)


def tree(nodes: DataFrame, group: str, *kept: str) -> tuple[DataFrame, DataFrame]:
    """(group, root) and the lowest blocks with `above`, the path of every block to its group's root.

    nodes has group, place, size, node and the kept columns; every round leaves one node for a block.
    """
    rounds = [blocks(nodes, group, *kept)]
    while rounds[-1].where(F.col("size") > WIDE).limit(1).count():
        below = rounds[-1].where(F.col("size") > WIDE)
        rounds.append(blocks(below.select(group, F.col("block").alias("place"), F.ceil(F.col("size") / WIDE).alias("size"), F.col("top").alias("node")), group))
    roots = [r.where(F.col("size") <= WIDE).select(group, F.col("top").alias("root")) for r in rounds]
    root = roots[0]
    for r in roots[1:]:
        root = root.unionByName(r)
    none = F.expr("CAST(array() AS array<struct<left:string,right:string>>)")
    above = rounds[-1].withColumn("above", none)
    for lower in reversed(rounds[:-1]):
        paths = above.select(group, F.inline(_paths(above, F.col("above")))).select(group, F.col("row.place").alias("block"), F.col("path").alias("above"))
        paths = materialise(paths, "paths")
        higher = lower.join(paths, [group, "block"], "left")
        above = higher.withColumn("above", F.coalesce("above", none))
    return materialise(root, "roots"), above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the segments of its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, order: str = "doc_id", source: str = "source", keep: list[str] = ()) -> DataFrame:
    """Of every leaf: its kept columns, leaf, subroot, root and path (what flanks it, level by level up to the root).

    docs has the columns leaf, `order`, `source` and those to keep.
    """
    named = docs.withColumn("in_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    seat = F.monotonically_increasing_id().alias("seat")  # deals equal rows out
    rows = materialise(named.select("in_source", F.col(order).alias("by"), F.col("leaf").alias("node"), seat, *keep), "leaves")
    subroots, lowest = tree(placed(rows, "in_source", ["by", "node", "seat"]), "in_source", *keep)
    tops = placed(subroots.select(F.lit(0).alias("all"), F.col("in_source").alias("by"), F.col("root").alias("node")), "all", ["by"])
    root, sources = tree(tops, "all", "by")
    ways = sources.select(F.inline(_paths(sources, F.col("above")))).select(F.col("row.by").alias("in_source"), F.col("row.node").alias("subroot"), F.col("path").alias("way"))
    joined = attach(lowest, with_scalar(ways, root.select("root")), ["in_source"], spread=["block"])
    each = joined.select("subroot", "root", "way", F.inline(_paths(joined, F.col("above"))))
    return each.select(*[F.col(f"row.{k}").alias(k) for k in keep], F.col("row.node").alias("leaf"), "subroot", "root", F.concat("path", "way").alias("path"))


def tampered_folds(docs: DataFrame) -> DataFrame:
    """The manifest of the documents, and for every fifth one the root folded from its text with A-Z lower-cased.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    rows = even(narrow(docs, **{c: c for c in FIELDS}), "doc_id")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    again = F.when(changed.isNotNull(), leaf_of([*[F.col(c) for c in FIELDS[:-1]], changed]))
    out = manifest(rows.select("doc_id", "source", leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), again.alias("again")), keep=["doc_id", "again"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    back = folded(F.coalesce("again", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)||':'||{c}::VARCHAR END"
    whole = lambda text: "||".join(part(c) for c in [*FIELDS[:-1], text])
    low = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR,''), lambda b: [ascii(b),-1,-1,-1,-1,-1,-1,-1,-1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT],{bits}::BIGINT[]), lambda c, o: CASE WHEN o>=0 THEN xor(c,o) ELSE xor(c>>1,3988292384*(c&1)) END),4294967295)"
    grown = lambda name, key, first: (f"{name}({key},lvl,i,h,n) AS ({first} UNION ALL SELECT {key}, lvl+1, i//{FAN}, sha256(string_agg(h,'' ORDER BY i)), ((max(n)+{FAN - 1})//{FAN})::BIGINT "  # noqa: E731
                                      f"FROM {name} WHERE n>1 GROUP BY {key}, lvl, i//{FAN})")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('='||source,'') AS src, sha256({whole('text')}) AS leaf, CASE WHEN ({crc})%5=0 THEN sha256({whole(low)}) ELSE sha256({whole('text')}) END AS used FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY src) AS n FROM d),
{grown('t', 'src', 'SELECT src, 0, i::BIGINT, leaf, n::BIGINT FROM o')},
r AS (SELECT src, h, lvl FROM t WHERE n=1),
{grown('u', 'a', "SELECT 0, 0, (row_number() OVER (ORDER BY src)-1)::BIGINT, h, count(*) OVER ()::BIGINT FROM r")},
g AS (SELECT src, h AS subroot, lvl AS high, row_number() OVER (ORDER BY src)-1 AS j FROM r),
m AS (SELECT src AS grp, lvl, i, h, n FROM t UNION ALL SELECT '*', lvl, i, h, n FROM u),
s AS (SELECT o.doc_id, o.src, o.i AS pos, m.lvl AS step, x.h, x.i AS si, m.i FROM o JOIN m ON m.grp=o.src AND m.n>1 AND m.i=o.i//({FAN}**m.lvl)::BIGINT JOIN m x ON x.grp=m.grp AND x.lvl=m.lvl AND x.i//{FAN}=m.i//{FAN}
UNION ALL SELECT o.doc_id, o.src, o.i, g.high+m.lvl, x.h, x.i, m.i FROM o JOIN g USING (src) JOIN m ON m.grp='*' AND m.n>1 AND m.i=g.j//({FAN}**m.lvl)::BIGINT JOIN m x ON x.grp='*' AND x.lvl=m.lvl AND x.i//{FAN}=m.i//{FAN}),
p AS (SELECT src, pos, step, coalesce(string_agg(h,'' ORDER BY si) FILTER (si<i),'') AS lef, coalesce(string_agg(h,'' ORDER BY si) FILTER (si>i),'') AS rig FROM s GROUP BY 1,2,3),
q AS (SELECT src, pos, sha256(string_agg(lef||rig,'' ORDER BY step)) AS proof FROM p GROUP BY 1,2),
f(src,pos,step,h) AS (SELECT src, i, 0, used FROM o UNION ALL SELECT f.src, f.pos, f.step+1, sha256(lef||f.h||rig) FROM f JOIN p ON p.src=f.src AND p.pos=f.pos AND p.step=f.step),
z AS (SELECT src, pos, arg_max(h,step) AS h FROM f GROUP BY 1,2)
SELECT o.doc_id, o.leaf, g.subroot, (SELECT h FROM u WHERE n=1) AS root, coalesce(q.proof,sha256('')) AS proof_sha256, z.h AS folded_root, z.h=(SELECT h FROM u WHERE n=1) AS verified
FROM o JOIN g USING (src) LEFT JOIN q ON q.src=o.src AND q.pos=o.i JOIN z ON z.src=o.src AND z.pos=o.i"""


@query(_sql())
def op11_manifest(spark, d):
    """Leaf, subroot, root and proof of every document, and the root its possibly changed row folds to."""
    return tampered_folds(table(spark, d, "documents"))
