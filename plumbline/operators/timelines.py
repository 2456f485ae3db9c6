"""Order-dependent facts about long event histories, cut into time buckets so that one busy key is shared by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import attach, materialise

BUCKET_ROWS = 2_000_000


def with_previous(df: DataFrame, by: Sequence[str], ts: str, event_id: str, values: Sequence[str], depth: int = 1, unit: str = "hour") -> DataFrame:
    """Adds prev_<value>_1 .. prev_<value>_<depth>: the values of the preceding events of the same key, null where there is none.

    Exact: a bucket hands its last `depth` events on, and since no bucket is empty the `depth` buckets before it hold all the
    events that can be needed. A task ranks one (key, bucket), not one key; the carried events are a small table. A bucket of
    more than BUCKET_ROWS events is cut into ranges of (time, id), so a burst inside one second is many tasks as well.
    """
    by, values = list(by), list(values)
    keyed = _bucketed(df, by, ts, event_id, unit)
    order = F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i"), *[F.col(v).alias(f"v{n}") for n, v in enumerate(values)])
    tails = _last_events(keyed, by, order, depth)
    none = F.array().cast(tails.schema["_tail"].dataType)
    back = Window.partitionBy(*by).orderBy("_bucket")  # one row per bucket of a key
    carried = F.flatten(F.array(*[F.coalesce(F.lag("_tail", k).over(back), none) for k in range(depth, 0, -1)]))
    tails = tails.withColumn("_carried", carried)
    carried = F.col("_carried")
    context = tails.select(*by, "_bucket", F.explode(F.slice(F.reverse(carried), 1, depth)).alias("c"))
    cols = [*by, "_bucket", ts, event_id, *values]
    old = context.select(*by, "_bucket", F.col("c.t").alias(ts), F.col("c.i").alias(event_id), *[F.col(f"c.v{n}").alias(v) for n, v in enumerate(values)], F.lit(False).alias("_own"))
    both = keyed.select(*cols, F.lit(True).alias("_own")).unionByName(old)
    w = Window.partitionBy(*by, "_bucket").orderBy(ts, event_id)
    lags = [F.lag(v, k).over(w).alias(f"prev_{v}_{k}") for v in values for k in range(1, depth + 1)]
    return both.select("*", *lags).where("_own").drop("_own", "_bucket")


def _bucketed(df: DataFrame, by: list[str], ts: str, event_id: str, unit: str) -> DataFrame:
    """Rows with their `_bucket`, which grows with time: the hour, and in a full hour the number of the range as well.

    Only the rows of full hours are moved by range, and written, so that every later use sees the same ranges.
    """
    keyed = df.withColumn("_bucket", F.date_trunc(unit, ts))
    on = [*by, "_bucket"]
    full = materialise(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_ROWS), "full")
    rows = full.agg(F.sum("_n")).first()[0]
    if not rows:
        return keyed
    held = F.array(*[F.coalesce(F.to_json(F.struct(c)), F.lit("{}")) for c in on])  # null is a key like any other here
    marked, full = keyed.withColumn("_held", held), full.select(held.alias("_held"))
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    burst = attach(marked, full, ["_held"], "left_semi", spread=[ts, event_id]).repartitionByRange(ranges, *by, ts, event_id)
    burst = materialise(burst.withColumn("_range", F.spark_partition_id()), "burst")
    calm = attach(marked, full, ["_held"], "left_anti", spread=[ts, event_id]).withColumn("_range", F.lit(0))
    cut = F.struct(F.col("_bucket").alias("at"), F.col("_range").alias("range"))
    return calm.unionByName(burst).withColumn("_bucket", cut).drop("_held", "_range")


def _last_events(keyed: DataFrame, by: list[str], event, depth: int) -> DataFrame:
    """(by, bucket, _tail): the last `depth` events of each bucket in order. The rank limit prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(F.desc("e.t"), F.desc("e.i")))
    top = keyed.select(*by, "_bucket", event.alias("e")).withColumn("_rank", rank).where(F.col("_rank") <= depth)
    return top.groupBy(*by, "_bucket").agg(F.array_sort(F.collect_list("e")).alias("_tail"))


def alerts_of_one_incident(events: DataFrame, service: str, signature: str, ts: str, event_id: str, minutes: int = 15) -> DataFrame:
    """Every alert with a predecessor of the same service and signature, and whether the two belong to one incident."""
    timed = events.withColumn("at", F.col(ts)).select(service, signature, ts, event_id, "at")
    prev = with_previous(timed, [service, signature], ts, event_id, ["at"], 1)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_at_1").cast("timestamp"))
    return prev.where(F.col("prev_at_1").isNotNull()).select(event_id, service, gap.alias("gap_us"), (gap <= minutes * 60_000_000).alias("same_incident"))


def looping_keys(events: DataFrame, key: str, call: str, ts: str, event_id: str, times: int = 3) -> DataFrame:
    """Per key: events that are at least the `times`-th equal one in a row, and whether there is any."""
    prev = with_previous(events.select(key, ts, event_id, call), [key], ts, event_id, [call], times - 1)
    same = F.lit(True)
    for k in range(1, times):
        same = same & (F.col(call) == F.col(f"prev_{call}_{k}"))
    return prev.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce(same, F.lit(False))).alias("repeats")).withColumn("looping", F.col("repeats") > 0)


def latest(events: DataFrame, key: str, ts: str, event_id: str, value: str) -> DataFrame:
    """The last value per key, on the map side first."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, event_id)).alias(value))
