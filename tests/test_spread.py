"""Tasks that grow in number with the rows: passes over well compressed tables, joins of ids, streams, and the work per row."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.functions.resampling import poisson_weights
from plumbline.functions.stats import POISSON_STEPS
from plumbline.operators import calibration as C
from plumbline.operators import guards as G
from plumbline.operators import metrics as M
from plumbline.operators import scale
from plumbline.operators import targets as T
from plumbline.sources import derived as S
from plumbline.streaming import jobs as J


def sizes(df):
    return df.rdd.glom().map(len).collect()


def test_one_split_of_many_rows_becomes_many_tasks(spark, tmp_path):
    spark.range(3_000).select("id", F.lit(None).cast("string").alias("s")).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    for ids in ((), ("id",)):
        out = scale.spread_rows(one, *ids, rows=100)
        assert len(sizes(out)) == 30 and max(sizes(out)) < 200
        assert sorted(r.id for r in out.collect()) == list(range(3_000))


def test_runs_are_drawn_in_tasks_of_few_cases(spark, monkeypatch):
    monkeypatch.setattr(S, "CASE_ROWS", 50)
    cases = S.cases(spark, SF)
    out = S.spread_cases(spark, SF)
    assert out.rdd.getNumPartitions() == -(-cases.count() // 50)
    assert max(sizes(out)) < 150 and out.exceptAll(cases).isEmpty() and cases.exceptAll(out).isEmpty()


def test_no_text_is_sorted_to_meet_its_label(spark):
    plan = S.judged_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("left", [lambda r, d: G.remaining(r, d, "row_id"), lambda r, d: T.unlabelled(r, d)])
def test_ids_left_over_are_found_in_as_many_tasks_as_the_ids_ask_for(spark, monkeypatch, left):
    monkeypatch.setattr(G, "JOIN_ROWS", 10)
    monkeypatch.setattr("plumbline.operators.guards.spread_rows", lambda df, *ids, rows: spread.append(scale.spread_rows(df, *ids, rows=rows)) or spread[-1])
    spread = []
    rows = spark.createDataFrame([(str(i), "f") for i in range(1_000)] + [("7", "f"), (None, "f")], "row_id string, family string")
    done = spark.createDataFrame([(str(i), None) for i in range(5, 1_000)] + [("7", ""), (None, None)], "row_id string, error string")
    out = left(rows, done)
    assert spread[0].rdd.getNumPartitions() == 100
    assert (out.first().missing if "missing" in out.columns else out.count()) == 6


def test_grid_sums_of_rows_of_many_lengths(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, None if n < 0 else (-rng.random(n) * 20).tolist()) for g in ("a", None, "b") for n in (1, 5, 2, 5, 0, 9, -1, 5, 1, 40)]
    d = [r or [] for _, r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows]), pa.array(d, pa.list_(pa.float64())), pa.array([len(x) for x in d])], names=["g", "d", "n_values"])
    for values in (8, 2048):
        monkeypatch.setattr(C, "VALUES", values)
        got = {r["g"]: r for b in C._grid_sums([batch], ["g"]) for r in b.to_pylist()}
        for g in ("a", None, "b"):
            mine = [np.array(x) for (k, _), x in zip(rows, d) if k == g]
            want = [sum(np.log(np.exp(x / t).sum()) for x in mine if len(x)) for t in C.GRID]
            assert got[g]["n"] == 10 and got[g]["l"] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_families_of_any_type_have_the_weights_of_their_digests():
    families = [5, 5, 12, 40]
    batch = pa.RecordBatch.from_arrays([pa.array(["r", "q", "r", "r"]), pa.array(["s"] * 4), pa.array(families), pa.array([1.0, None, 0.5, 0.0]), pa.array([1, 2, 3, 4])],
                                       names=["run_id", "slice", "family_id", "s", "n"])
    got = {r["run_id"]: r for b in M._weighted_sums([batch], 19, "seed") for r in b.to_pylist()}

    def weight(family, draw):
        part = hashlib.sha256(f"seed:{draw // 8}:{family}".encode()).digest()[4 * (draw % 8):][:4]
        return sum(int.from_bytes(part, "big") > s for s in POISSON_STEPS)

    assert got["r"]["s"] == pytest.approx([weight(5, i) + 0.5 * weight(12, i) for i in range(19)])
    assert got["r"]["n"] == [weight(5, i) + 3 * weight(12, i) + 4 * weight(40, i) for i in range(19)]
    assert got["q"]["s"] == [0.0] * 19 and not got["q"]["known"] and got["q"]["n"] == [2 * weight(5, i) for i in range(19)]


class State:
    hasTimedOut = False

    def __init__(self, value=None):
        self.get, self.waits = value, None

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def setTimeoutDuration(self, ms):
        self.waits = ms

    def getCurrentProcessingTimeMs(self):
        return 1_000


def frame(*rows):
    return pd.DataFrame(rows, columns=["row_id", "row", "attempt", "tie"])


def admitted(state, *frames):
    return [tuple(r) for out in J._admitted(("k",), iter(frames), state, 50) for r in out.itertuples(index=False)]


def test_an_id_is_admitted_without_sorting_its_rows(monkeypatch):
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)  # a sort of one row costs more than the rest of the call
    state = State()
    assert admitted(state, frame(("k", "b", 0, 9), ("k", "c", 0, 7)), frame(("k", "a", 0, 7))) == [("k", "a", 1)]
    assert state.get == (1, None, None)
    assert admitted(state, frame(("k", "b", 0, 9))) == [] and state.waits is None
    assert admitted(state, frame(("k", "b", 0, 9), ("k", "a", 1, 0))) == [] and state.get == (1, "a", 1_050) and state.waits == 50
    state.waits = None
    assert admitted(state, frame(("k", "b", 0, 9))) == [] and state.waits == 50 and state.get == (1, "a", 1_050)


def test_a_batch_of_requests_is_answered_in_as_many_tasks_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "spread_rows", lambda df: seen.append(scale.spread_rows(df, rows=20)) or seen[-1])
    ask = '{"q":{"type":"noul","instructions":"x","criteria":{}}}'
    rows = spark.range(1_000).select(F.col("id").alias("request_id"), F.lit("s").alias("state"), F.when(F.col("id") % 2 == 0, ask).otherwise("not json").alias("questions"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    keys = F.array(F.lit("false"), F.lit("true"))
    order = F.struct(keys.alias("order"), F.map_from_arrays(keys, F.array(F.lit(0.25), F.lit(0.75))).alias("by_key"))
    score = lambda good: good.select("request_id", F.lit("q").alias("name"), F.lit("noul").alias("task_type"), keys.alias("option_keys"), F.array(order).alias("orders"))
    cal = spark.createDataFrame([("noul", None, 1.0, 0.0)], "task_type string, temperature double, a double, b double")
    J.decision_stream(J.read_files(spark, str(tmp_path / "in"), rows.schema), score, cal, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    assert [df.rdd.getNumPartitions() for df in seen] == [50, 25]
    assert spark.read.parquet(str(tmp_path / "out" / "batch=*")).where("abs(noul - 0.75) < 1e-9").count() == 500
    assert spark.read.parquet(str(tmp_path / "bad" / "batch=*")).count() == 500


def draws_of(family, draws, seed="bootstrap"):
    hashed = b"".join(hashlib.sha256(f"{seed}:{i}:{family}".encode()).digest() for i in range(-(-draws // 8)))
    return np.searchsorted(POISSON_STEPS, np.frombuffer(hashed, ">u4")[:draws].astype(np.int64))


@pytest.mark.parametrize("draws,seed", [(2000, "bootstrap"), (13, "s\u00e9 d:")])
def test_weights_of_families_are_drawn_from_their_digests(spark, draws, seed):
    """Names of no, one and several blocks of the digest, and a number."""
    names = ["", "\u00fc", *["f" * n for n in (37, 38, 39, 40, 41, 55, 56, 64, 200)]]
    df = spark.createDataFrame([(n,) for n in names], "f string").repartition(3)
    for r in df.select("f", poisson_weights(spark, "f", draws, seed).alias("w")).collect():
        assert list(r.w) == draws_of(r.f, draws, seed).tolist()
    assert list(spark.range(7, 8).select(poisson_weights(spark, "id", draws, seed)).first()[0]) == draws_of(7, draws, seed).tolist()


@pytest.mark.parametrize("kind", ["string", "double"])
def test_an_interval_is_summed_in_tasks_of_few_rows(spark, monkeypatch, kind):
    """Against sums draw by draw: records without a slice, a run, a gold or a family, and families that go on in the next batch."""
    rows = [(run, part, None if i % 13 == 5 else f"f{i % 40}" if kind == "string" else i % 40 / 4, "score" if part == "x" else "noul", "bad" if i % 11 == 3 else None,
             str(i % 3), None if part == "none" or i % 17 == 2 else "1", i % 5 / 2) for run in ("a", "b", None) for part in ("x", "y", "none", None) for i in range(90)]
    df = spark.createDataFrame(rows, f"run_id string, slice string, family_id {kind}, task_type string, error string, pred string, gold string, expected_level double")
    monkeypatch.setattr(M, "INTERVAL_ROWS", 10)
    monkeypatch.setattr(M, "FAMILIES", 3)
    monkeypatch.setattr(M, "CELLS", 7)
    monkeypatch.setattr(M, "SUMS_HELD", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = M.bootstrap_interval(df, 100)
        got = {r[:2]: r[2:] for r in map(tuple, out.collect())}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {8 * -(-len(rows) // 80)}), REPARTITION_BY_NUM" in plan
    assert ("plumbline_poisson" in plan) == (kind == "string")  # other types are drawn in Python
    cells = {}
    for run, part, family, task, error, pred, gold, level in rows:
        if family is not None and not error:
            cell = cells.setdefault((run, part), {}).setdefault(family, [None, 0])
            cell[1] += 1
            if gold is not None:
                cell[0] = (cell[0] or 0.0) + (abs(level - float(gold)) if task == "score" else float(pred == gold))
    assert got.keys() == cells.keys()
    for key, of in cells.items():
        w = np.array([draws_of(f, 100) for f in of])
        s, n = (np.array([c[i] or 0 for c in of.values()]) @ w for i in (0, 1))
        want = (None, None) if all(c[0] is None for c in of.values()) else tuple(np.percentile((s / n)[n > 0], [2.5, 97.5]))
        assert got[key] == pytest.approx(want, abs=1e-12) if want[0] is not None else got[key] == want
