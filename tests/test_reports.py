"""Packing, closures, runtime summaries and report tables on hand-made rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import batching, compare, lineage, metrics
from plumbline.sources import tables
from plumbline.streaming import jobs


def greedy(lengths, budget):
    out, batch, count = [], -1, 0
    for x in sorted(lengths):
        if count and x * (count + 1) <= budget:
            count += 1
        else:
            batch, count = batch + 1, 1
        out.append((x, batch, count - 1))
    return out


@pytest.mark.parametrize(("block", "budget"), [(16384, 500), (3, 500), (1, 37), (5, 100_000)])
def test_packing_is_greedy_for_any_blocks(spark, block, budget):
    rng = random.Random(block)
    lengths = [rng.choice([1, 2, rng.randint(1, 60), rng.randint(1, 900)]) for _ in range(500)] + [7] * 300
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(-1, None)], "id long, size long")
    got = batching.token_batches(rows, "size", ["id"], budget, block).collect()
    assert sorted((r["size"], r["batch"], r["place"]) for r in got) == greedy(lengths, budget)
    assert {r.id for r in got} == set(range(len(lengths)))


def test_packing_of_many_lengths_stays_in_blocks(spark):
    counts = spark.range(1, 200_001).select(F.col("id").alias("len"), F.lit(2).cast("bigint").alias("n"))
    plan = batching.packing_plan(counts, 48_000)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    sample = {r["len"]: r for r in plan.where("len IN (1, 30000, 200000)").collect()}
    want = {}
    for x, batch, _ in greedy([x for x in range(1, 200_001) for _ in range(2)], 48_000):
        want.setdefault(x, batch)
    assert {x: r["batch"] if r["open"] else r["batch"] + 1 for x, r in sample.items()} == {x: want[x] for x in sample}


def test_ancestors_of_a_long_chain_and_a_cycle(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", None), (None, "y"), ("a", "b")]
    rounds, plain = [], lineage.materialise
    monkeypatch.setattr(lineage, "materialise", lambda df, name="t": rounds.append(name) or plain(df, name))
    found = lineage.ancestors(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([("n0",), ("n990",), ("a",), ("z",)], "hub_id string"))
    got = {(r.hub_id, r.ancestor): r.depth for r in found.collect()}
    want = {("n0", f"n{i}"): i for i in range(1, 1001)} | {("n990", f"n{990 + i}"): i for i in range(1, 11)} | {("a", "b"): 1, ("a", "c"): 1, ("a", "a"): 2}
    assert got == want
    assert len(rounds) <= 12


def test_merged_summaries_stay_within_one_percent(spark):
    rng = np.random.default_rng(6)
    parts = [("r1", rng.gamma(2, 30, 20_000)), ("r2", np.round(rng.normal(100, 5, 15_000))), ("r3", np.full(10_000, 50.0))]
    kind = "run_id string, slice string, latency_ms double, input_tokens long, retries int"
    rows = spark.createDataFrame([(run, "s", float(x), 10, i % 3 % 2) for run, xs in parts for i, x in enumerate(xs)] + [("r1", "s", None, None, None), ("r4", "t", None, 5, 1)], kind)
    stored = [metrics.runtime_summaries(rows.where(F.col("run_id") == r)) for r in ("r1", "r2", "r3", "r4")]
    merged = metrics.merged_summaries(stored[0].union(stored[1]).union(stored[2]).union(stored[3]), ["slice"])
    got = {r.slice: r for r in metrics.runtime_from_summaries(merged, ["slice"]).collect()}
    values = np.sort(np.concatenate([x for _, x in parts]))
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        x = got["s"][f"latency_ms_{name}"]
        assert np.searchsorted(values, x, "left") / len(values) - 0.01 <= q <= np.searchsorted(values, x, "right") / len(values) + 0.01
    again = sum(i % 3 % 2 for _, xs in parts for i in range(len(xs)))
    assert (got["s"].n, got["s"].input_tokens_total, got["s"].retries, got["s"].input_tokens_mean) == (45_000, 450_000, again, 10.0)
    assert (got["t"].n, got["t"].latency_ms_p50, got["t"].input_tokens_total, got["t"].retries) == (0, None, 5, 1)
    exact = {r.slice: r for r in metrics.runtime(rows, ["slice"]).collect()}
    assert (exact["t"].n, exact["t"].latency_ms_p50, exact["t"].input_tokens_mean) == (0, None, 5.0)
    assert abs(exact["s"].latency_ms_p50 - np.percentile(values, 50)) < 1e-9


def test_report_tables(spark):
    kind = "run_id string, slice string, family_id string, perturbation string, task_type string, pred string, gold string, error string, latency_ms double, case_id string"
    rows = [("a", "s", "f1", "none", "choice", "x", "x", None, 10.0, "1"), ("a", "s", "f1", "permuted", "choice", "y", "x", None, 20.0, "2"), ("a", "t", "f2", "none", "choice", "x", "x", None, 7.4, "3"),
            ("b", "s", "f1", "none", "choice", "x", "x", "", 30.0, "1"), ("b", "s", "f1", "permuted", "choice", "x", "x", "late", None, "2")]
    preds = spark.createDataFrame(rows, kind)
    got = {(r.run_id, r.slice): (r.flipped_permille, r.p50_ms) for r in metrics.order_and_latency(preds).collect()}
    assert got == {("a", "s"): ("1000", "20"), ("a", "t"): ("n/a", "7"), ("b", "s"): ("n/a", "30"), ("b", "t"): ("n/a", "n/a")}
    out = compare.served_check(preds.where("run_id = 'a'"), preds.where("run_id = 'b'"), 0.4).first()
    assert (out.cases, out.errors, out.p50_ms, out.p95_ms, out.passed) == (2, 1, 30.0, 30.0, True)


def numbered_files(spark, root, n, rows=10):
    """Files of `rows` rows with ascending idx, in the order of their times."""
    os.makedirs(root)
    for i in range(n):
        spark.range(i * rows, (i + 1) * rows).withColumnRenamed("id", "idx").coalesce(1).write.parquet(f"{root}-{i}")
        name = next(f for f in os.listdir(f"{root}-{i}") if f.endswith(".parquet"))
        with open(f"{root}-{i}/{name}", "rb") as source, open(f"{root}/f{i}.parquet", "wb") as target:
            target.write(source.read())
        os.utime(f"{root}/f{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.mark.parametrize(("limits", "kept", "seen"), [({"max_kept": 7}, [0, 3, 6, 9, 12, 15, 18], 19), ({"max_seen": 15}, [0, 3, 6, 9, 12], 15), ({"max_kept": 4, "max_seen": 15}, [0, 3, 6, 9], 10)])
def test_a_pass_stops_its_source(spark, tmp_path, limits, kept, seen):
    root = f"{tmp_path}/in"
    numbered_files(spark, root, 5)
    for i in (2, 3, 4):  # what follows the stop cannot be read
        with open(f"{root}/f{i}.parquet", "wb") as broken:
            broken.write(b"not a table")
        os.utime(f"{root}/f{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    def run(endless=False):
        stream = jobs.read_files(spark, root, spark.range(0).withColumnRenamed("id", "idx").schema, files_per_batch=1)
        query = jobs.filtered_pass(stream, F.col("idx") % 3 == 0, f"{tmp_path}/kept", f"{tmp_path}/counts", f"{tmp_path}/check", **limits, endless=endless)
        assert query.awaitTermination(60)

    run(endless=True)
    counts = lambda: spark.read.parquet(f"{tmp_path}/counts/batch=*").agg(F.sum("seen"), F.sum("kept")).first()
    rows = lambda: sorted(r.idx for r in spark.read.parquet(f"{tmp_path}/kept/batch=*").collect())
    assert (rows(), tuple(counts())) == (kept, (seen, len(kept)))
    run()
    assert (rows(), tuple(counts())) == (kept, (seen, len(kept)))


def test_landed_splits_are_the_only_ones_read(spark, tmp_path):
    root = f"{tmp_path}/set"
    for config in ("a", "b"):
        for split in ("train", "test", "dev"):
            tables.land(spark.range(5 if split == "train" else 2).select("id", F.array(F.struct(F.lit(1).alias("x"), F.lit("y").alias("z"))).alias("parts")), root, config, split)
    tables.land(spark.range(0).select("id", F.array(F.struct(F.lit(1).alias("x"), F.lit("y").alias("z"))).alias("parts")), root, "b", "dev")
    read = tables.landed(spark, root, "a", ["train", "dev"])
    assert {(r.config, r.split): r.n for r in read.groupBy("config", "split").agg(F.count("*").alias("n")).collect()} == {("a", "train"): 5, ("a", "dev"): 2}
    assert all("config=a/split=train" in f or "config=a/split=dev" in f for f in read.inputFiles())
    assert "config=b" not in read._jdf.queryExecution().executedPlan().toString()
    assert tables.landed(spark, root, "b").count() == 7 and tables.landed(spark, root, "b", ["dev"]).count() == 0
    assert sorted((r.config, r.split, r["rows"]) for r in tables.manifest(spark, root).collect())[0] == ("a", "dev", 2)
    for config, splits in (("c", None), ("a", ["valid"])):
        with pytest.raises(ValueError, match="has no split"):
            tables.landed(spark, root, config, splits)
    tables.land(spark.range(3), root, "a", "odd")
    with pytest.raises(ValueError, match="differ"):
        tables.landed(spark, root, "a")
