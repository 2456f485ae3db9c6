"""Shared ways to keep an operator whole when one key holds a large part of the rows.

* `materialise` writes an intermediate table to the shared folder and reads it back, which cuts the lineage.
* `attach` joins facts to a one-row-per-key table: broadcast when rows and bytes allow it, with salted hot keys otherwise.
* `hash_positions` and `take_by_hash` rank and sample a group without ever sorting the group in one task.
* `running_totals` gives exact prefix sums of an ordered group, block by block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 32
HOT_SHARE = 64  # a key with more than one of 64 rows is hot
TASK_ROWS, JOIN_ROWS = 50_000, 200_000  # of one task: in a CPU-heavy pass, whatever few bytes the rows have; of ids in a join
HASH_DIGITS = 4  # 65,536 blocks per group
BLOCKS = 256
BLOCK_ROWS = 4_000_000
STEP = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if named:
        return named.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", for_cpu: bool = False) -> DataFrame:
    """Write a table once to the shared folder and read it back; later use does not recompute it.

    for_cpu: the table feeds CPU-heavy passes; when it came out in fewer splits than there are cores (a small table, by the
    size of a split) it is rewritten in one file per core.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if for_cpu and out.rdd.getNumPartitions() < cores:
        return materialise(out.repartition(cores), name)
    return out


def task_count(df: DataFrame) -> int:
    """Tasks for a CPU-heavy stage over few bytes, which adaptive execution would otherwise merge into one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *ids: str) -> DataFrame:
    """A small table that arrives in fewer splits than there are cores is spread over the cores; a large one is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *ids) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, *ids: str, rows: int = TASK_ROWS) -> DataFrame:
    """A table over as many tasks as keep each near `rows` rows, one per core at least, by the hash of ids (of all columns).

    Splits are cut by bytes: well compressed rows come by the million in one split, and so do those of one row group. The rows
    are counted first, so hand in a table that is cheap to count.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *(ids or [f"`{c}`" for c in df.columns]))


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Both the rows and the bytes of a table stay under their bounds, counted in one job that stops at max_rows."""
    from pyspark.sql import types as T

    def width(f):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0)) + 16
        return F.lit(8)

    total = F.lit(0).cast("bigint")
    for f in dim.schema.fields:
        total = total + width(f)
    n, size = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def attach(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] = (),
           ready: bool = False, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join facts to a table with at most one row per key, whatever the skew of the keys on the facts' side.

    The table is written first (unless ready), so its size is known: within the bounds of fits_broadcast it is broadcast, and
    the facts do not move. Of a larger one only the hot keys (more than one of HOT_SHARE facts, so HOT_SHARE keys at most) are
    copied to every salt, by a hash of the facts' `spread` columns; all others are joined plainly.
    """
    if not ready:
        dim = materialise(dim, "dim")
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), list(on), how)
    on = list(on)
    counts = materialise(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_k")), "keys")
    total = counts.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    hot = materialise(counts.where(F.col("_k") > total / HOT_SHARE).select(*on), "hot")
    if not spread or not hot.limit(1).count():
        return facts.join(dim, on, how)
    cold = facts.join(F.broadcast(hot), on, "left_anti").join(dim, on, how)
    salted = facts.join(F.broadcast(hot), on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = dim.join(F.broadcast(hot), on, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cold.unionByName(salted.join(copies, [*on, "_salt"], how).drop("_salt"))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _grouping(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _hash_blocks(df: DataFrame, by: list[str], ids: Sequence[str], seed) -> tuple[DataFrame, DataFrame]:
    keyed = df.withColumn("_h", hash_order(seed, *ids)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    counts = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return keyed, counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def hash_positions(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed, name: str = "position") -> DataFrame:
    """Exact zero-based position of every row in its group's hash order.

    The group is cut into blocks by hash prefix: block counts give the offsets, and only a block is sorted in one task. Join
    and ranking use the same keys, so the rows move once.
    """
    base, keys = _grouping(df, by)
    keyed, blocks = _hash_blocks(base, keys, ids, seed)
    rows = keyed.join(blocks.select(*keys, "_b", "_before"), [*keys, "_b"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *ids))
    return rows.withColumn(name, (F.col("_before") + rank - 1).cast("bigint")).select(*df.columns, name)


def take_by_hash(df: DataFrame, quota: int | Column | DataFrame, by: Sequence[str] = (), ids: Sequence[str] = ("row_id",),
                 seed="sample", strict: bool = False) -> DataFrame:
    """Exactly the first `quota` rows of each group in hash order (all rows of a smaller group).

    quota is a number, an expression over the group columns, or a table (group columns, quota). A histogram of hash prefixes
    finds the block in which each group's quota ends; rows below it pass without a shuffle and only that block is ranked.
    """
    base, keys = _grouping(df, by)
    keyed, blocks = _hash_blocks(base, keys, ids, seed)
    if isinstance(quota, DataFrame):
        blocks = attach(blocks, quota.select(*keys, F.col("quota").alias("_quota")), keys)
    else:
        blocks = blocks.withColumn("_quota", quota if isinstance(quota, Column) else F.lit(int(quota)))
    cut = materialise(blocks.groupBy(*keys).agg(
        F.max(F.when(F.col("_before") < F.col("_quota"), F.col("_b"))).alias("_cut"),
        (F.max("_quota") - F.max(F.when(F.col("_before") < F.col("_quota"), F.col("_before")))).alias("_need"),
        F.sum("_n").alias("_size"), F.max("_quota").alias("_quota")), "cut")
    if strict:
        short = cut.where(F.col("_size") < F.col("_quota")).select(*keys, "_size", "_quota").limit(3).collect()
        if short:
            raise ValueError(f"fewer rows than the quota asks for, e.g. {[r.asDict() for r in short]}")
    hit = attach(keyed, cut.select(*keys, "_cut", "_need"), keys, spread=ids, ready=True)
    sure = hit.where(F.col("_b") < F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *ids))
    edge = hit.where(F.col("_b") == F.col("_cut")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need"))
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def _ordered_blocks(base: DataFrame, keys: list[str], order: str, sums: Sequence[str], descending: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their block `_b`, and per (group, block) the sums before it `_o<i>` and inside it `_t<i>`.

    Approximate quantiles cut each group into blocks, as many as keep a block near BLOCK_ROWS rows (written once, so every
    use sees the same edges); the result is exact for any edges.
    """
    largest = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    blocks = max(BLOCKS, -(-largest // BLOCK_ROWS))
    quantiles = [i / blocks for i in range(1, blocks)]
    found = base.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), quantiles, max(2_000, 8 * blocks)).alias("_edges"))
    every = F.sequence(F.lit(STEP - 1), F.lit(blocks - 2), F.lit(STEP))
    edges = materialise(found.withColumn("_steps", F.transform(every, lambda i: F.get("_edges", i))), "edges")
    placed = attach(base, edges, keys, spread=[order], ready=True)
    value = F.col(order).cast("double")
    below = lambda c: F.size(F.filter(c, lambda e: e < value))
    placed = placed.withColumn("_s", below("_steps") * STEP)  # the steps first, then the edges of one step
    block = F.col("_s") + below(F.slice("_edges", F.col("_s") + 1, F.lit(STEP)))
    placed = placed.withColumn("_b", -block if descending else block).drop("_edges", "_steps", "_s")
    sizes = placed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return placed, sizes.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))], *[f"_t{i}" for i in range(len(sums))])


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Inclusive prefix sums `sums = {new: column}` along a numeric `order` that is unique within its group.

    Block totals give the offsets; only a block is ordered in one task.
    """
    base, keys = _grouping(df, by)
    placed, offsets = _ordered_blocks(base, keys, order, list(sums.values()), descending)
    sort = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "_b").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(offsets, [*keys, "_b"])
    for i, (name, c) in enumerate(sums.items()):
        rows = rows.withColumn(name, F.col(f"_o{i}") + F.sum(c).over(inside))
    return rows.select(*df.columns, *sums)


def values_at(df: DataFrame, by: Sequence[str], value: str, index) -> DataFrame:
    """The value at a zero-based index of each group's sorted values; index maps names to expressions over `n`.

    Equal values are counted first; block counts tell which blocks hold the wanted ranks, and only those are sorted.
    """
    base, keys = _grouping(df.where(F.col(value).isNotNull()), by)
    counts = materialise(base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "counts")
    placed, offsets = _ordered_blocks(counts, keys, value, ["_c"], False)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    holds = F.lit(False)
    for i in index.values():
        holds = holds | ((F.col("_o0") <= i) & (i < F.col("_o0") + F.col("_t0")))
    wanted = materialise(offsets.join(sizes, keys).where(holds).select(*keys, "_b", "_o0", "n"), "blocks")
    rows = attach(placed, wanted, [*keys, "_b"], ready=True, spread=[value])
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("_upto", F.col("_o0") + F.sum("_c").over(inside))
    first = F.col("_upto") - F.col("_c")
    picks = [F.max(F.when((first <= i) & (i < F.col("_upto")), F.col(value))).alias(name) for name, i in index.items()]
    return upto.groupBy(*keys).agg(F.max("n").alias("n"), *picks).drop("_all")
