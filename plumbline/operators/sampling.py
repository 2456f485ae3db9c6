"""Samples, caps, balancing, holdouts and splits, all decided by hash so that partitioning never changes a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_order, held_out
from .scale import attach, hash_positions, materialise, take_by_hash

# Default caps of a training mix.
CAP_COLLECTION, CAP_OTHER, GENERATED_REPEAT = 400, 3000, 2


def sample_rows(df: DataFrame, cap: int, ids: Sequence[str], seed, keep: Column | None = None) -> DataFrame:
    """Up to `cap` rows that pass a filter."""
    return take_by_hash(df.where(keep) if keep is not None else df, cap, ids=ids, seed=seed)


def two_class_sample(df: DataFrame, first: Column, cap: int, ids: Sequence[str], seed) -> DataFrame:
    """Half the cap from the first class, the remainder (also what the first class lacks) from the other."""
    tagged = df.withColumn("_first", first)
    have = tagged.where("_first").agg(F.count(F.lit(1)).alias("n"))
    quota = materialise(have.select(F.least(F.col("n"), F.lit(cap // 2)).alias("a")).select(F.explode(F.array(
        F.struct(F.lit(True).alias("_first"), F.col("a").alias("quota")), F.struct(F.lit(False).alias("_first"), (F.lit(cap) - F.col("a")).alias("quota")))).alias("q")).select("q.*"), "quota")
    return take_by_hash(tagged, quota, ["_first"], ids, seed).drop("_first")


def mix(rows: DataFrame, seed, cap_collection: int = CAP_COLLECTION, cap_other: int = CAP_OTHER, repeat: int = GENERATED_REPEAT) -> DataFrame:
    """Caps per family by class of family, generated rows repeated under new ids, held-out families untouched.

    A family is held out as a whole, decided by any of its rows; it has to be uniform.
    """
    kind = (F.when(F.col("holdout_family"), F.lit("held-out")).when(F.col("family").startswith("syn_"), F.lit("synthetic"))
            .when(F.col("family").startswith("sni_"), F.lit("collection")).otherwise(F.lit("other")))
    tagged = rows.withColumn("share", kind)
    capped = tagged.where(F.col("share").isin("collection", "other"))
    quota = F.when(F.col("share") == "collection", F.lit(cap_collection)).otherwise(F.lit(cap_other))
    kept = take_by_hash(capped, quota, ["family", "share"], ["row_id"], seed)
    generated = repeat_rows(tagged.where(F.col("share") == "synthetic"), repeat)
    return kept.unionByName(generated).unionByName(tagged.where(F.col("share") == "held-out"))


def repeat_rows(rows: DataFrame, copies: int) -> DataFrame:
    """Every row `copies` times; a repeat carries `~k` in its id."""
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    more = rows.withColumn("_k", k)
    return more.withColumn("row_id", F.when(F.col("_k") == 0, F.col("row_id")).otherwise(F.concat_ws("~", "row_id", "_k"))).drop("_k")


def mix_share(mixed: DataFrame) -> DataFrame:
    """Rows per share and their part of the trainable rows."""
    s = mixed.groupBy("share").agg(F.count(F.lit(1)).alias("n"))
    trainable = F.sum(F.when(F.col("share") != "held-out", F.col("n"))).over(Window.partitionBy(F.lit(0)))  # a few rows
    return s.withColumn("part", F.when(F.col("share") != "held-out", F.col("n") / trainable))


def quota_sample(df: DataFrame, quota: dict[str, int], key: str, ids: Sequence[str], seed, strict: bool = True) -> DataFrame:
    """A fixed number per source; too few rows is an error unless strict is off."""
    n = F.lit(0)
    for k, v in quota.items():
        n = F.when(F.col(key) == k, F.lit(v)).otherwise(n)
    return take_by_hash(df.where(F.col(key).isin(list(quota))), n, [key], ids, seed, strict)


def capped_and_numbered(df: DataFrame, cap: int, by: Sequence[str], ids: Sequence[str], seed, name: str = "made") -> DataFrame:
    """Up to `cap` rows per group with dense numbers from zero."""
    return hash_positions(take_by_hash(df, cap, by, ids, seed), by, ids, seed, name)


def balanced_by_quota(df: DataFrame, total: int, by: Sequence[str], answer: str, options: str, ids: Sequence[str], seed) -> DataFrame:
    """Each answer at most ceil(total / options) times within its group, so no group favours one answer."""
    quota = F.ceil(F.lit(float(total)) / F.col(options))
    return take_by_hash(df, quota, [*by, answer, options], ids, seed)


def downsample_to_rarest(df: DataFrame, by: Sequence[str], answer: str, ids: Sequence[str], seed) -> DataFrame:
    """Every answer cut to the count of the rarest answer of its group."""
    counts = df.groupBy(*by, answer).agg(F.count(F.lit(1)).alias("n"))
    floor = counts.withColumn("quota", F.min("n").over(Window.partitionBy(*by)))  # one row per answer
    return take_by_hash(df, floor.select(*by, answer, "quota"), [*by, answer], ids, seed)


def family_sample(df: DataFrame, n: int, by: str, family: str, seed, exclude: DataFrame | None = None) -> DataFrame:
    """`n` families per slice with all their rows, leaving out the families of another set."""
    families = df.groupBy(by, family).agg(F.count(F.lit(1)).alias("_size")).drop("_size")
    if exclude is not None:
        families = families.join(exclude.select(family).distinct(), family, "left_anti")
    chosen = take_by_hash(families, n, [by], [family], seed)
    return df.join(chosen, [by, family], "left_semi")


def stratified_families(df: DataFrame, n: int, by: str, family: str, seed) -> DataFrame:
    """About n / slices rows per slice in whole families: a family is taken while fewer rows than that were taken before it."""
    families = materialise(df.groupBy(by, family).agg(F.count(F.lit(1)).alias("size")), "families")
    slices = families.select(by).distinct().count()
    per = max(1, n // max(1, slices))
    # at most `per` families can be needed per slice, since every family brings at least one row
    first = take_by_hash(families, per, [by], [family], seed).withColumn("_h", hash_order(seed, family))
    earlier = Window.partitionBy(by).orderBy("_h", family).rowsBetween(Window.unboundedPreceding, -1)
    chosen = first.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).where(F.col("before") < per)
    return df.join(chosen.select(by, family), [by, family], "left_semi")


def first_per_group(df: DataFrame, n: int, by: str, order: Sequence[str]) -> DataFrame:
    """The first n rows of each group in id order: a salted round first, so a hot group is cut down before its last ranking."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    w1, w2 = Window.partitionBy(by, "_salt").orderBy(*order), Window.partitionBy(by).orderBy(*order)
    near = salted.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n)
    return near.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_rn", "_salt")


def fixed_per_group(df: DataFrame, n: int, by: Sequence[str], ids: Sequence[str], seed) -> DataFrame:
    return take_by_hash(df, n, by, ids, seed)


def shard(df: DataFrame, i: int, n: int, ids: Sequence[str]) -> DataFrame:
    """Shard i of n. By the hash of the id, so a row keeps its shard when rows are added."""
    return df.where(F.pmod(hash_int(F.concat_ws(":", *ids)), F.lit(n)) == i)


def shard_by_position(df: DataFrame, i: int, n: int, ids: Sequence[str], seed) -> DataFrame:
    """Shard i of n by exact position: shard sizes differ by one at most."""
    return hash_positions(df, (), ids, seed, "_pos").where(F.col("_pos") % n == i).drop("_pos")


def split_by_fraction(rows: DataFrame, share: float = 0.02) -> DataFrame:
    """train / val / unseen: held-out families apart, then a fraction of ids."""
    return rows.withColumn("split", F.when(F.col("holdout_family"), F.lit("unseen")).when(held_out("row_id", share), F.lit("val")).otherwise(F.lit("train")))


def split_by_modulus(rows: DataFrame, modulus: int = 50, max_options: int = 26) -> DataFrame:
    """The other split rule: ids whose hash is divisible by the modulus; questions with too many options are left out."""
    val = hash_int("row_id") % modulus == 0
    return rows.where(F.col("n_options") <= max_options).withColumn(
        "split", F.when(F.col("holdout_family"), F.lit("unseen")).when(val, F.lit("val")).otherwise(F.lit("train")))


def hold_out_groups(df: DataFrame, n: int, group: str, seed) -> DataFrame:
    """Mark the rows of n whole groups."""
    groups = df.select(group).distinct()
    chosen = take_by_hash(groups, n, (), [group], seed).withColumn("_held", F.lit(True))
    return attach(df, chosen, [group], "left").withColumn("holdout_family", F.col("_held").isNotNull()).drop("_held")


def shuffled(df: DataFrame, ids: Sequence[str], seed) -> DataFrame:
    """Global shuffle: a range-partitioned sort on the hash, one slice of the order per task."""
    return df.withColumn("_h", hash_order(seed, *ids)).orderBy("_h", *ids).drop("_h")


def length_percentiles(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Tenth percentile, median and maximum of a length, at the index n // 10 and n // 2 of the sorted lengths."""
    from .scale import values_at
    n = F.col("n")
    return values_at(df, by, length, {"p10": F.floor(n / 10).cast("bigint"), "median": F.floor(n / 2).cast("bigint"), "longest": n - 1})


