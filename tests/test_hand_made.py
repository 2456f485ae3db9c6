"""Hand-made rows for what the derived tables cannot show: long chains, large label sets, hot keys, repeated records, text states."""

import hashlib
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as C
from plumbline.operators import combine as X
from plumbline.operators import compare as D
from plumbline.operators import convert as V
from plumbline.operators import guards as G
from plumbline.operators import lineage as L
from plumbline.operators import scale, timelines
from plumbline.sources import tables as IO
from plumbline.streaming import jobs as J


def test_ancestors_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(14)] + [("m14", "m3")], "child string, parent string")
    got = {r.ancestor: r.depth for r in L.ancestors(edges, spark.createDataFrame([("m0",)], "hub_id string")).collect()}
    assert got == {f"m{i}": i for i in range(1, 15)}


@pytest.mark.parametrize("rows", [200_000, 5])
def test_ten_thousand_and_one_labels(spark, monkeypatch, rows):
    """A label set beyond any list, by broadcast (200,000) and by joining the rows' numbers (5)."""
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(scale.fits_broadcast, "__defaults__", (rows, scale.BROADCAST_BYTES))
    df = spark.range(10_001).select("id", F.concat(F.lit("label "), F.col("id")).alias("label"), F.lit("t").alias("text"))
    pool = V.label_pool(df, "label")
    out = V.intents(df.where("id % 500 = 0"), ["id"], "text", "label", pool).collect()
    assert len(out) == 21
    for r in out:
        keys = [o.key for o in r.options]
        assert len(set(keys)) == len(keys) and (r.gold in keys)


def test_padding_goes_around_a_short_ring(spark):
    records = spark.createDataFrame([(i, chr(97 + i) * 50) for i in range(20)], "record_id long, text string")
    rows = spark.createDataFrame([(f"r{i}", '{"a":1}', i) for i in range(6)], "row_id string, state string, origin long")
    out = V.long_context(rows, records, 6).collect()
    assert len(out) == 6
    for r in out:
        texts = json.loads(r.state)["unrelated_context"]["records"]
        size = sum(len(t) + 4 for t in texts)
        assert 7000 <= size < 14000 + 54 and chr(97 + r.origin) * 50 not in texts
    with pytest.raises(Exception, match="no record to pad"):
        V.long_context(rows.where("origin = 0"), records.where("record_id = 0"), 1).collect()


def test_last_record_of_a_case_wins(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    lines = [{"case_id": "a", "pred": "x"}, {"case_id": "b", "pred": "y"}, {"case_id": "a", "pred": "z"}]
    (run / "predictions.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = IO.read_predictions(spark, str(tmp_path), "case_id string, pred string").collect()
    assert sorted((r.case_id or "", r.pred) for r in got) == [("", None), ("a", "z"), ("b", "y")]


def test_a_repeated_record_stops_the_ensemble(spark):
    kind = "run_id string, case_id string, error string, pred string, latency_ms double, option_keys array<string>, probs array<double>, task_type string"
    one = ("r", "c", None, "a", 1.0, ["a", "b"], [0.7, 0.3], "choice")
    two = ("s", "c", None, "a", 1.0, ["a", "b"], [0.5, 0.5], "choice")
    with pytest.raises(Exception, match="more than one record"):
        X.ensemble(spark.createDataFrame([one, one, two], kind), ["r", "s"], "mean").collect()


def test_scorers_are_compared_by_option(spark):
    kind = "case_id string, slice string, option_keys array<string>, probs array<double>, pred string"
    left = spark.createDataFrame([("c", "s", ["a", "b"], [0.9, 0.1], "a")], kind)
    right = spark.createDataFrame([("c", "s", ["b", "a"], [0.1, 0.9], "a")], kind)
    assert D.scorer_difference(left, right).first().max_difference == 0.0


def test_states_that_are_plain_text(spark):
    rows = spark.createDataFrame([(1, "plain text"), (2, '{"b":1, "a":2}'), (3, '{"a":2,"b":1}'), (4, "plain text"), (5, None), (6, "plain  text")], "id long, state string")
    assert sorted(r.id for r in G.drop_exact_copies(rows, ["state"], "id").collect()) == [1, 2, 5, 6]
    banned = spark.createDataFrame([], "hash string")
    kept = G.decontaminate(rows.where("state IS NOT NULL"), banned, rows.where("id IN (1, 3)"), ["id"])
    assert sorted(r.id for r in kept.collect()) == [6]


def test_overlap_guard_aborts(spark):
    text = "a line that is certainly longer than forty characters, twice"
    rows = spark.createDataFrame([(1, json.dumps({"t": text}))], "id long, state string")
    with pytest.raises(ValueError, match="share text"):
        G.assert_no_overlap(rows, G.field_hashes(rows, ["id"]), ["id"])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_beyond_the_broadcast_bound(spark, monkeypatch, how):
    """One key with a third of the rows, a dimension too large for a broadcast by rows or by bytes."""
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("k"))
    dim = spark.range(400).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("v"))
    want = sorted(map(tuple, facts.join(dim, "k", how).select("id", "k").collect()))
    for bounds in ((10, 1 << 30), (10_000, 1000)):
        monkeypatch.setattr(scale.fits_broadcast, "__defaults__", bounds)
        got = scale.attach(facts, dim, ["k"], how, spread=["id"], max_rows=bounds[0])
        assert sorted(map(tuple, got.select("id", "k").collect())) == want


@pytest.mark.parametrize("rows", [2_000_000, 10])
def test_a_burst_of_one_key_inside_an_hour(spark, monkeypatch, rows):
    monkeypatch.setattr(timelines, "BUCKET_ROWS", rows)
    ev = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
                                  F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 20)).alias("ts"), (F.col("id") % 4).cast("string").alias("call"))
    got = {r.key: (r.events, r.repeats) for r in timelines.looping_keys(ev, "key", "call", "ts", "event_id").collect()}
    want = {}
    for r in ev.orderBy("ts", "event_id").collect():
        calls = want.setdefault(r.key, [])
        calls.append(r.call)
    assert got == {k: (len(c), sum(c[i] == c[i - 1] == c[i - 2] for i in range(2, len(c)))) for k, c in want.items()}


def test_a_burst_inside_one_second_is_many_tasks(spark, monkeypatch):
    """One key's events in one second, more than a bucket holds, some at equal times, with a calm key and a null one beside it."""
    n = 120_000
    monkeypatch.setattr(timelines, "BUCKET_ROWS", 80_000)
    ev = spark.range(n + 2000).select(F.col("id").alias("event_id"), F.when(F.col("id") < n, "hot").when(F.col("id") % 2 == 0, "calm").alias("key"),
                                      F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.floor(F.col("id") * 37 % 99_991)).alias("ts"), (F.col("id") % 7 % 2).cast("string").alias("call"))
    buckets = timelines._bucketed(ev, ["key"], "ts", "event_id", "hour").groupBy("key", "_bucket").count().collect()
    hot = [r["count"] for r in buckets if r.key == "hot"]
    assert sum(hot) == n and len(hot) >= 4 and max(hot) < timelines.BUCKET_ROWS / 2
    got = {r.key: (r.events, r.repeats) for r in timelines.looping_keys(ev, "key", "call", "ts", "event_id").collect()}
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    want = {}
    for key, part in pdf.groupby(pdf["key"].fillna("none")):
        c = part["call"].to_numpy()
        want[None if key == "none" else key] = (len(c), int(((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])).sum()))
    assert got == want


@pytest.mark.parametrize("options", [4, 40])
def test_temperature_search_finds_the_best_of_all(spark, options):
    import math
    import random
    rng = random.Random(options)
    rows = []
    for i in range(150):
        z = [rng.gauss(0, 2) for _ in range(options)]
        rows.append(("g" + str(i % 3), z, rng.randrange(options) if rng.random() < 0.5 else z.index(max(z))))
    rows += [("flat", [0.0] * options, 0)] * 5
    got = {r.k: r.temperature for r in C.fit_temperature(spark.createDataFrame(rows, "k string, z array<double>, g int"), ["k"]).collect()}
    for k in got:
        mine = [(z, g) for n, z, g in rows if n == k]
        loss = lambda t: round(sum(math.log(sum(math.exp((x - z[g]) / t) for x in z)) for z, g in mine) / len(mine), 12)  # noqa: E731,B023
        assert got[k] == min(C.GRID, key=lambda t: (loss(t), t))  # noqa: B023


def test_early_stop_carries_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)  # files arrive in order
    stream = J.read_files(spark, str(src), spark.range(1).schema, files_per_batch=1)
    J.filtered_pass(stream, F.col("id") % 2 == 0, str(tmp_path / "kept"), str(tmp_path / "counts"), str(tmp_path / "check"), max_kept=8, max_seen=1000, order="id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/kept/batch=*").collect()) == [0, 2, 4, 6, 8, 10, 12, 14]


def test_labels_resume_and_retry_into_one_store(spark, tmp_path):
    src, where = tmp_path / "in", {n: str(tmp_path / n) for n in ("labels", "retry", "check")}
    for part in ([("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(part, "row_id string, n long").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    label = lambda name, bad: lambda rows: rows.select("row_id", F.lit(name).alias("teacher"), F.when(F.col("row_id") == bad, "timeout").alias("error"))
    J.label_stream(J.read_files(spark, str(src), "row_id string, n long", files_per_batch=1), label("one", "c"), where["labels"], where["retry"], where["check"]).awaitTermination()
    assert sorted(r.row_id for r in J.read_labels(spark, where["labels"]).collect()) == ["a", "b"]
    J.retry_labels(spark.read.parquet(str(src)).distinct(), label("two", None), where["labels"], where["retry"])
    assert sorted((r.row_id, r.teacher) for r in J.read_labels(spark, where["labels"]).collect()) == [("a", "one"), ("b", "one"), ("c", "two")]


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "sub" / "two.bin").write_bytes(b"x")
    got = {r.file: (r.bytes, r.sha256) for r in L.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {"one.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest()), "two.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_a_manifest_reads_large_files_in_pieces(spark, tmp_path):
    """A sparse file of 3 GB, beyond what one value can hold, and names that a URI writes otherwise."""
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "p%41ü+x.bin").write_bytes(b"abc" * 1000)
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    zeros, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        zeros.update(piece)
    want = {"large.bin": (3 << 30, zeros.hexdigest())}
    got = {r.file: (r.bytes, r.sha256) for r in L.file_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got["large.bin"] == want["large.bin"]
    every = {r.bytes: r.sha256 for r in L.file_manifest(spark, str(tmp_path / "a b"), whole=100).collect()}
    assert every == {3000: hashlib.sha256(b"abc" * 1000).hexdigest()}


def test_a_global_shuffle_is_in_hash_order(spark):
    from plumbline.operators import sampling
    ids = [f"row{i % 90}" for i in range(100)]
    got = [r.row_id for r in sampling.shuffled(spark.createDataFrame([(i,) for i in ids], "row_id string").repartition(7), ["row_id"], "seed").collect()]
    assert got == sorted(ids, key=lambda i: hashlib.sha256(f"seed:{i}".encode()).hexdigest())


def test_an_interval_does_not_depend_on_how_tasks_are_cut(spark, monkeypatch):
    from plumbline.operators import metrics
    rows = [(run, part, f"f{i % 60}", "noul", None if i % 11 else "", str(i % 3 == 0).lower(), "true", None) for run in "ab" for part in "xy" for i in range(150)]
    df = spark.createDataFrame(rows, "run_id string, slice string, family_id string, task_type string, error string, pred string, gold string, expected_level double")
    want = sorted(map(tuple, metrics.bootstrap_interval(df, 100).collect()))
    for name in ("SUMS_HELD", "FAMILIES", "CELLS"):
        monkeypatch.setattr(metrics, name, 2)
    got = sorted(map(tuple, metrics.bootstrap_interval(df, 100).collect()))
    assert len(want) == 4 and all(w[2] < w[3] for w in want)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(a - b) < 1e-12 for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_a_fit_over_rows_of_every_width(spark, monkeypatch):
    from plumbline.operators import calibration as C
    rng = random.Random(5)
    rows = [(f"g{i % 3}", [rng.uniform(-4, 0) for _ in range(rng.choice((2, 3, 40)))], 1) for i in range(200)] + [("g0", [-1.0, -2.0], None), ("none", [-1.0], 5)]
    df = spark.createDataFrame(rows, "k string, z array<double>, g int")
    want = sorted(map(tuple, C.fit_temperature(df, ["k"]).collect()))
    monkeypatch.setattr(C, "GROUPS_HELD", 1)
    monkeypatch.setattr(C, "VALUES", 16)
    assert sorted(map(tuple, C.fit_temperature(df, ["k"]).collect())) == want
    for k, temperature, n in want:
        mine = [(z, g) for key, z, g in rows if key == k]
        loss = lambda t: round(sum(math.log(sum(math.exp((v - z[g]) / t) for v in z)) for z, g in mine if g is not None and g < len(z)) / len(mine), 12)  # noqa: B023, E731
        assert n == len(mine) and temperature == min(C.GRID, key=lambda t: (loss(t), t))
