"""Labelling with retries in keyed state: repeated ids, attempts that run out, a batch that is replayed, a restart."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import jobs as J

SCHEMA = "row_id string, n long, at timestamp, extra struct<attempt:int,names:array<string>>"


def landed(spark, path, *parts):
    for part in parts:
        rows = [(i, n, datetime.datetime(2026, 1, 2, 3, 4, 5, 678901), (n, [i or "", None])) for i, n in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files arrive in order


def teacher(rows):
    """c fails once, d always, e has no record the first time."""
    failed = (F.col("row_id") == "c") & (F.col("attempt") == 1) | (F.col("row_id") == "d")
    known = rows.where("row_id <> 'e' OR attempt > 1")
    return known.select("row_id", "attempt", "n", "at", "extra", F.when(failed, "timeout").otherwise("").alias("error"))


def labels(spark, where):
    return sorted((r.row_id, r.attempt) for r in J.read_labels(spark, where["labels"]).collect())


@pytest.fixture
def where(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "labels", "retry", "check")}


def started(spark, where, label=teacher, **more):
    stream = J.read_files(spark, where["in"], SCHEMA, files_per_batch=1)
    return J.label_with_retries(stream, label, where["labels"], where["retry"], where["check"], interval=0.2, **{"attempts": 3, "delay": 0.5, **more})


def test_failed_rows_come_back_and_every_id_has_one_label(spark, where):
    landed(spark, where["in"], [("a", 1), ("b", 2), ("a", 1), (None, 9), ("d", 4)], [("b", 2), ("c", 3), ("e", 5), ("d", 4)])
    started(spark, where).awaitTermination()
    assert labels(spark, where) == [("a", 1), ("b", 1), ("c", 2), ("e", 2)]
    given_up = spark.read.parquet(f"{where['retry']}/failed/batch=*").select("row_id", "attempt").collect()
    assert [(r.row_id, r.attempt) for r in given_up] == [("d", 3)]
    whole = {r.row_id: r for r in J.read_labels(spark, where["labels"]).collect()}  # what waited came back unchanged
    assert (whole["c"].n, whole["c"].at, whole["c"].extra.names) == (3, datetime.datetime(2026, 1, 2, 3, 4, 5, 678901), ["c", None])
    landed(spark, where["in"], [("a", 1), ("f", 6), ("d", 4)])  # a restart knows what it has seen
    started(spark, where).awaitTermination()
    assert labels(spark, where) == [("a", 1), ("b", 1), ("c", 2), ("e", 2), ("f", 1)]


def test_a_failed_row_waits_for_its_delay(spark, where):
    landed(spark, where["in"], [("c", 3)])
    asked = []

    def timed(rows):
        asked.append(time.time())
        return teacher(rows)

    started(spark, where, timed, delay=4.0).awaitTermination()
    assert labels(spark, where) == [("c", 2)] and len(asked) == 2 and asked[1] - asked[0] >= 4


def test_a_replayed_batch_leaves_one_label(spark, where):
    landed(spark, where["in"], [("a", 1), ("c", 3), ("b", 2)])
    broken = []

    def breaks_once(rows):
        """The first retry is cut off after its records were asked for: the batch is not committed and runs again."""
        if rows.where("attempt = 2").count() and not broken:
            broken.append(1)
            raise RuntimeError("cut off")
        return teacher(rows)

    with pytest.raises(Exception, match="cut off"):
        started(spark, where, breaks_once).awaitTermination()
    assert labels(spark, where) == [("a", 1), ("b", 1)]
    started(spark, where, breaks_once).awaitTermination()
    assert labels(spark, where) == [("a", 1), ("b", 1), ("c", 2)]
