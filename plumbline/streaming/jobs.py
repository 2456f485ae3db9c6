"""Structured Streaming jobs: labelling that resumes, an incremental filtered pass, and online decisions.

Every job takes a streaming DataFrame, writes through foreachBatch and keeps its checkpoint in the shared folder, so a restart
continues where the last committed batch ended. Batch writes go to a folder per batch id and overwrite it, which makes a
replayed batch harmless.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.probability import argmax, expected_level, let, normalise, platt, softmax
from ..operators.combine import served_two_orders
from ..operators.guards import request_problems, retry_set
from ..operators.scale import materialise, spread_rows

LABEL_BUCKETS = 64
WAITING = "row_id string, row string, attempt int"
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is in an output folder so far, with its batch ids; empty before the first batch."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    except Exception as exc:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def _bucket(row_id: str = "row_id"):
    return F.pmod(F.xxhash64(row_id), F.lit(LABEL_BUCKETS)).cast("int")


def _done(spark: SparkSession, labels_path: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """Ids that other batches have labelled, read from the hash buckets a batch touches and from no other column."""
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    past = _written(spark, labels_path, schema).where(F.col("batch") != batch_id)
    return past.where(F.col("bucket").isin(buckets)).select("row_id")


def _store(records: DataFrame, labels_path: str, retry_path: str, batch_id: int) -> None:
    """Label records of one batch, made once in a staging folder beside the store, then good ones and failed ones apart."""
    spark = records.sparkSession
    out = f"{labels_path}-staged/batch={batch_id}"
    records.write.mode("overwrite").parquet(out)
    good, bad = retry_set(spark.read.schema(records.schema).parquet(out))
    good.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{labels_path}/batch={batch_id}")
    bad.write.mode("overwrite").parquet(f"{retry_path}/batch={batch_id}")


def label_stream(rows: DataFrame, label: Callable[[DataFrame], DataFrame], labels_path: str, retry_path: str, checkpoint: str) -> StreamingQuery:
    """Label rows as they arrive: exactly one good label per row id in one label store, failed rows in a retry table.

    `label` maps rows to label records (row_id, ..., error). A row that already has a label is skipped, also when it arrives
    twice in one batch (of rows with one id the one with the smallest hash is labelled) or when a batch is replayed.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "row_id"]
        once = batch.groupBy("row_id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")).select("row_id", "_r.*") if rest else batch.distinct()
        buckets = sorted(r[0] for r in batch.select(_bucket().alias("b")).distinct().collect())  # LABEL_BUCKETS at most
        _store(label(once.join(_done(spark, labels_path, batch_id, buckets), "row_id", "left_anti")), labels_path, retry_path, batch_id)

    return _start(rows, each, checkpoint)


def retry_rows(rows: DataFrame, spark: SparkSession, labels_path: str, retry_path: str) -> DataFrame:
    """Rows of the retry table that still have no label: the input of the next attempt."""
    failed = spark.read.parquet(f"{retry_path}/batch=*").select("row_id").distinct()
    return rows.join(failed, "row_id", "left_semi").join(_done(spark, labels_path, -1 << 62, list(range(LABEL_BUCKETS))), "row_id", "left_anti")


def retry_labels(rows: DataFrame, label: Callable[[DataFrame], DataFrame], labels_path: str, retry_path: str, attempt: int = 1) -> None:
    """One attempt (1, 2, ...) at the rows that failed, into the same label store; what fails again stays in the retry table."""
    _store(label(retry_rows(rows, rows.sparkSession, labels_path, retry_path)), labels_path, retry_path, -attempt)


def _admitted(key, frames, state, delay_ms: int):
    """What of one id is to be labelled now. State: attempts made, and the row with the time it is due while it waits."""
    if state.hasTimedOut:
        attempt, row, _ = state.get
        state.update((attempt, None, None))
        if row is not None:
            yield pd.DataFrame({"row_id": [key[0]], "row": [row], "attempt": [attempt + 1]})
        return
    parts = list(frames)
    attempts, rows, ties = ([x for p in parts for x in p[c].tolist()] for c in ("attempt", "row", "tie"))  # lists: most ids have one row
    last = max(range(len(rows)), key=attempts.__getitem__)
    if attempts[last] > 0:
        state.update((attempts[last], rows[last], state.getCurrentProcessingTimeMs() + delay_ms))
        state.setTimeoutDuration(delay_ms)
    elif not state.exists:
        state.update((1, None, None))
        yield pd.DataFrame({"row_id": [key[0]], "row": [min(zip(ties, rows))[1]], "attempt": [1]})
    elif state.get[1] is not None:  # came again while it waits: the timer of a key ends with every call
        state.update(state.get)
        state.setTimeoutDuration(max(1, int(state.get[2]) - state.getCurrentProcessingTimeMs()))


def label_with_retries(rows: DataFrame, label: Callable[[DataFrame], DataFrame], labels_path: str, retry_path: str, checkpoint: str, attempts: int = 3,
                       delay: float = 10.0, interval: float = 1.0, endless: bool = False) -> StreamingQuery:
    """Label rows as they arrive and again, `delay` seconds later, where that failed: one good label per row id, in one query.

    State per id tells what was seen, so the label store is never read; a failed row comes back through a folder that the query
    itself reads, waits in the state of its id and leaves it by a timer. `label` maps rows (the columns of `rows` and
    `attempt`, from 1) to records (row_id, ..., error); a row whose record is missing has failed. What failed `attempts` times is
    written to the folder `failed` below retry_path. Unless endless, the query ends once no file is new and no row waits.

    Of rows with one id in one batch the one with the smallest hash is labelled; later ones are passed over; rows without id
    take no part. A replayed batch overwrites its folders and sees the same state and clock. The state holds one small entry
    per id for good and a row only while it waits: on a cluster keep it in the RocksDB state store.
    """
    spark, schema = rows.sparkSession, rows.schema
    spark.createDataFrame([], WAITING).write.mode("ignore").parquet(f"{retry_path}/again/batch=-1")
    packed = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), EXACT_TIMES)
    fresh = rows.where("row_id IS NOT NULL").select("row_id", packed.alias("row"), F.lit(0).alias("attempt"), F.xxhash64(*rows.columns).alias("tie"))
    again = read_files(spark, f"{retry_path}/again", T.StructType.fromDDL(WAITING)).select("row_id", "row", "attempt", F.lit(0).cast("bigint").alias("tie"))
    turn = fresh.union(again).groupBy("row_id").applyInPandasWithState(
        partial(_admitted, delay_ms=max(1, round(delay * 1000))), WAITING, "attempt int, row string, due bigint", "append", "ProcessingTimeTimeout")
    staged = f"{labels_path}-staged"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged}/admitted/batch={batch_id}")
        due = spark.read.schema(batch.schema).parquet(f"{staged}/admitted/batch={batch_id}")
        if due.isEmpty():
            return
        asked = due.select(F.from_json("row", schema, EXACT_TIMES).alias("r"), "attempt").select("r.*", "attempt")
        records = label(asked)
        records.write.mode("overwrite").parquet(f"{staged}/records/batch={batch_id}")
        good, _ = retry_set(spark.read.schema(records.schema).parquet(f"{staged}/records/batch={batch_id}"))
        good.write.mode("overwrite").parquet(f"{labels_path}/batch={batch_id}")
        bad = due.join(good.select("row_id"), "row_id", "left_anti")
        bad.where(F.col("attempt") >= attempts).write.mode("overwrite").parquet(f"{retry_path}/failed/batch={batch_id}")
        bad.where(F.col("attempt") < attempts).write.mode("overwrite").parquet(f"{retry_path}/again/batch={batch_id}")
        due.where("attempt > 1").select("row_id").write.mode("overwrite").parquet(f"{staged}/retried/batch={batch_id}")  # the batch's last act

    def waiting() -> int:
        return _written(spark, f"{retry_path}/again", T.StructType.fromDDL(WAITING)).count() - _written(spark, f"{staged}/retried", T.StructType.fromDDL("row_id string")).count()

    query = turn.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{round(interval * 1000)} milliseconds").start()
    if not endless:
        threading.Thread(target=_stop_when_settled, args=(query, waiting, interval), daemon=True).start()
    return query


def _stop_when_settled(query: StreamingQuery, waiting: Callable[[], int], pause: float) -> None:
    """Ends a query whose last two batches read nothing (the first one of a restart may be a replay) while no failed row waits."""
    while query.isActive:
        last = query.recentProgress[-2:]
        if len(last) == 2 and not any(p["numInputRows"] for p in last) and waiting() == 0:
            query.stop()
            return
        time.sleep(pause)


def read_labels(spark: SparkSession, labels_path: str) -> DataFrame:
    """The label store as a table."""
    return spark.read.option("basePath", labels_path).parquet(f"{labels_path}/batch=*").drop("batch", "bucket")


def filtered_pass(stream: DataFrame, keep, kept_path: str, counts_path: str, checkpoint: str, max_kept: int | None = None, max_seen: int | None = None,
                  order: str = "idx", endless: bool = False) -> StreamingQuery:
    """Incremental pass over an unbounded source: rows passing a filter are kept, with running counts per batch.

    With limits the query ends by itself once max_kept were kept or max_seen were seen; both counts carry over batches and
    restarts, and `seen` counts up to the row that met the limit. A batch is admitted by its files (see read_files), written once
    and then read from there; a batch after the stop is never read, so its files are not opened. endless: go on waiting for files
    instead of ending with those that are there.
    """
    spark, met = stream.sparkSession, threading.Event()
    counts_schema = T.StructType([T.StructField("seen", T.LongType()), T.StructField("kept", T.LongType()), T.StructField("batch", T.LongType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        past = _written(spark, counts_path, counts_schema).where(F.col("batch") < batch_id).agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("s"), F.coalesce(F.sum("kept"), F.lit(0)).alias("k")).first()
        left = [None if most is None else most - past[c] for most, c in ((max_seen, "s"), (max_kept, "k"))]
        if any(n is not None and n <= 0 for n in left):
            met.set()
            return
        staged = f"{kept_path}-staged/batch={batch_id}"
        batch.withColumn("_keep", F.coalesce(keep, F.lit(False))).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        shown = rows if left[0] is None else rows.orderBy(order).limit(left[0])
        good = shown.where("_keep").drop("_keep")
        out = f"{kept_path}/batch={batch_id}"
        (good if left[1] is None else good.orderBy(order).limit(left[1])).write.mode("overwrite").parquet(out)
        kept, last = spark.read.schema(batch.schema).parquet(out).agg(F.count(F.lit(1)), F.max(order) if left[1] is not None else F.lit(None)).first()
        full = left[1] is not None and kept >= left[1]
        seen = shown.where(F.col(order) <= F.lit(last)).count() if full else shown.count()
        spark.range(1).select(F.lit(seen).cast("bigint").alias("seen"), F.lit(kept).cast("bigint").alias("kept")).write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")
        if full or left[0] is not None and seen >= left[0]:
            met.set()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime="1 second") if endless else writer.trigger(availableNow=True)).start()
    if max_kept is not None or max_seen is not None:
        threading.Thread(target=_stop_when, args=(query, met), daemon=True).start()
    return query


def _stop_when(query: StreamingQuery, met: threading.Event) -> None:
    while query.isActive:
        if met.wait(0.2):
            query.stop()
            return


def answers(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """Calibrated answers for scored questions: (request_id, name, task_type, option_keys, orders) joined to the table of types.

    The calibration table has one row per answer type.
    """
    rows = served_two_orders(scored).join(F.broadcast(calibration.select("task_type", "temperature", "a", "b")), "task_type", "left")
    p = let(normalise("probs"), lambda q: F.get(q, (F.array_position("option_keys", F.lit("true")) - 1).cast("int")))
    floor = lambda c: F.log(F.greatest(c, F.lit(1e-15)))
    rows = rows.withColumn("noul_raw", F.when(F.col("task_type") == "noul", p))
    odds = floor(F.col("noul_raw")) - floor(F.lit(1.0) - F.col("noul_raw"))
    pair = platt(odds, F.coalesce("a", F.lit(1.0)), F.coalesce("b", F.lit(0.0)))
    logs = F.transform("probs", lambda x: floor(x))
    rows = rows.withColumn("calibrated", F.when(F.col("task_type") == "noul", pair).otherwise(softmax(logs, F.coalesce("temperature", F.lit(1.0)))))
    noul = F.col("task_type") == "noul"
    return rows.select(
        "request_id", "name", "task_type", "noul_raw", F.when(noul, F.get("calibrated", F.lit(1))).alias("noul"),
        F.when(F.col("task_type") == "choice", F.get("option_keys", argmax("calibrated"))).alias("choice"),
        F.when(F.col("task_type") == "score", expected_level("option_keys", "calibrated")).alias("score"), F.when(~noul, F.array_max("calibrated")).alias("confidence"))


def decision_stream(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], calibration: DataFrame, answers_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Requests to answers: a request with a problem goes to the rejected table, the rest is scored and calibrated."""

    def each(batch: DataFrame, batch_id: int) -> None:
        checked = materialise(request_problems(spread_rows(batch)), "checked")
        checked.where(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        good = spread_rows(checked.where(F.col("reject_reason").isNull()).drop("reject_reason"))
        answers(scorer(good), calibration).write.mode("overwrite").parquet(f"{answers_path}/batch={batch_id}")

    return _start(requests, each, checkpoint)
