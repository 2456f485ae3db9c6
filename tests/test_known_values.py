"""Published values and invariants that do not come from the tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import options as O
from plumbline.functions import probability as PR
from plumbline.functions import rules as R
from plumbline.functions import stats, text
from plumbline.functions.hashing import half, hash_fraction, text_hash
from plumbline.operators import batching as B
from plumbline.operators import calibration as C
from plumbline.operators import compare as D
from plumbline.operators import convert as V
from plumbline.operators import lineage as L
from plumbline.operators import sampling as K
from plumbline.operators import scale
from plumbline.operators import targets as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_mcnemar_exact_values(spark):
    pairs = [(0, 0, 1.0), (5, 5, 1.0), (22, 7, 0.0081300586), (1, 0, 1.0), (103, 58, None), (24, 2, 1.049041748e-05)]
    df = spark.createDataFrame([(w, r) for w, r, _ in pairs], "w long, r long")
    got = {(x.w, x.r): x.p for x in df.select("w", "r", stats.mcnemar_p("w", "r").alias("p")).collect()}
    for w, r, p in pairs:
        n, k = w + r, min(w, r)
        exact = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert got[w, r] == pytest.approx(exact, rel=1e-9)
        if p is not None:
            assert got[w, r] == pytest.approx(p, abs=1e-8)


def test_mcnemar_stays_exact_for_large_counts(spark):
    w, r = 50_000, 50_600
    exact = 2 * sum(math.exp(math.lgamma(w + r + 1) - math.lgamma(i + 1) - math.lgamma(w + r - i + 1) - (w + r) * math.log(2)) for i in range(w + 1))
    assert one(spark, stats.mcnemar_p(F.lit(w), F.lit(r))).c0 == pytest.approx(exact, rel=1e-7)


def test_ece_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.10000001,), (0.5,), (0.55,), (1.0,)], "c double")
    assert [x.b for x in df.select(stats.ece_bin("c").alias("b")).collect()] == [0, 0, 1, 4, 5, 9]


@pytest.mark.parametrize("how", ["arith", "geo"])
def test_mean_over_orders(spark, how):
    """A mean is a distribution, agrees with plain numpy, and of equal distributions it is that distribution."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet(np.ones(5), 3)
    lit = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    want = p.mean(0) if how == "arith" else np.exp(np.log(p).mean(0)) / np.exp(np.log(p).mean(0)).sum()
    assert one(spark, PR.mean_distribution(lit(p), how)).c0 == pytest.approx(want.tolist())
    assert one(spark, PR.mean_distribution(lit([p[0]] * 4), how)).c0 == pytest.approx(p[0].tolist())


def greedy(lengths, most):
    """(batch, place) of lengths in the given order under rows times longest row."""
    out, batch, count, longest = [], -1, 0, 0
    for n in lengths:
        if count and max(longest, n) * (count + 1) <= most:
            count, longest = count + 1, max(longest, n)
        else:
            batch, count, longest = batch + 1, 1, n
        out.append((batch, count - 1))
    return out


@pytest.mark.parametrize("most", [1, 37, 300, 100_000])
def test_packing_is_one_greedy_pass(spark, most):
    rng = np.random.default_rng(most)
    lengths = [int(x) for x in np.concatenate((rng.integers(1, 60, 300), rng.integers(200, 500, 20), [0, 17, 17, 17]))]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
    got = {r.id: (r.batch, r.place) for r in B.token_batches(df, "n", ["id"], most).collect()}
    order = sorted(got, key=lambda i: (lengths[i], got[i]))
    assert [got[i] for i in order] == greedy([lengths[i] for i in order], most)
    batches = spark.createDataFrame([(i // 8, i % 8, n) for i, n in enumerate(lengths)], "b long, place long, n long")
    pieces = {(r.b, r.place): r.piece for r in B.split_by_tokens(batches, ["b"], "place", "n", most).collect()}
    for b in {k[0] for k in pieces}:
        mine = sorted(k[1] for k in pieces if k[0] == b)
        assert [pieces[b, i] for i in mine] == [x for x, _ in greedy([lengths[b * 8 + i] for i in mine], most)]


def test_licence_keys_ignore_case_blanks_and_unknown_names(spark):
    for name, spelt in L.CANONICAL.items():
        forms = [name, name.upper(), f"  {spelt} ", name.replace("-", "_"), name.replace("-", " ")]
        got = spark.createDataFrame([(f,) for f in forms], "l string").select(L.licence_key("l").alias("k"), L.permissive("l").alias("ok")).collect()
        assert {r.k for r in got} == {name} and all(r.ok for r in got)
    assert not any(r.ok for r in spark.createDataFrame([("house rules",), (None,), (" ",)], "l string").select(L.permissive("l").alias("ok")).collect())
    with pytest.raises(Exception, match="licence_not_permitted"):
        one(spark, L.licence_names(F.array(F.lit("house rules"))))


def test_calibration_table_checks(spark):
    df = spark.createDataFrame([("choice", 0.0, None, None), ("noul", None, float("nan"), 0.0)], "task_type string, temperature double, a double, b double")
    got = {x.task_type: x.problem for x in C.calibration_problems(df).collect()}
    assert got["score"] == "missing" and "positive" in got["choice"] and "finite" in got["noul"]


def test_regression_and_non_inferiority_on_known_counts(spark):
    """960 paired cases, 22 newly wrong and 7 newly right: a regression, and just outside the margin; 8 and 14 is neither."""
    def cases(run, wrong, right):
        rows = []
        for i in range(960):
            base_ok = not 500 <= i < 520
            ok = base_ok
            if i < wrong:
                ok = False
            if 500 <= i < 500 + right:
                ok = True
            rows.append((run, f"c{i}", "s", "noul", "true" if ok else "false", "true", None))
        return rows
    base = [("base", f"c{i}", "s", "noul", "false" if 500 <= i < 520 else "true", "true", None) for i in range(960)]
    df = spark.createDataFrame(base + cases("p2", 22, 7) + cases("p1", 8, 14), "run_id string, case_id string, slice string, task_type string, pred string, gold string, error string")
    got = {x.run_id: x for x in D.assess(df, "base", ["none"]).collect()}
    assert (got["p2"].n, got["p2"].newly_wrong, got["p2"].newly_right) == (960, 22, 7)
    assert got["p2"].regresses and not got["p2"].non_inferior and got["p2"].accuracy_change == pytest.approx(-15 / 960)
    assert not got["p1"].regresses and got["p1"].non_inferior and got["p1"].eligible
    best = D.choose(D.assess(df, "base", ["none"])).first()
    assert best.chosen == "p1" and best.eligible == 1


def test_missing_runs_are_never_eligible(spark):
    schema = "run_id string, case_id string, slice string, task_type string, pred string, gold string, error string"
    rows = [("base", f"c{i}", f"s{i % 2}", "noul", "true", "true", None) for i in range(40)]
    part = [("part", f"c{i}", f"s{i % 2}", "noul", "true", "true", None) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows + part, schema)
    got = D.assess(df, "base", []).first()
    assert got.coverage == 0.0 and not got.eligible
    names = spark.createDataFrame([("part",), ("failed",)], "run_id string")
    assert [x.run_id for x in D.missing_candidates(df, names).collect()] == ["failed"]
    assert D.choose(D.assess(df, "base", [])).first().best is None


def test_platt_and_temperature_match_plain_loops(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=400) * 2
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.7 * x + 0.4)))).astype(float)
    w, X = np.array([0.1, 0.0]), np.c_[x, np.ones(400)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -50, 50)))
        w = w - np.linalg.solve((X.T * (p * (1 - p))) @ X / 400 + 0.01 * np.eye(2), X.T @ (p - y) / 400 + 0.01 * w)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    got = C.fit_platt(df, ["k"]).first()
    assert (got.a, got.b) == pytest.approx(tuple(w), abs=1e-9)
    z = rng.normal(size=(200, 4)) * 3
    g = [int(np.argmax(r + rng.gumbel(size=4) * 1.7)) for r in z]
    losses = [np.mean([np.log(np.exp((r - r[i]) / t).sum()) for r, i in zip(z, g)]) for t in C.GRID]
    df = spark.createDataFrame([("k", [float(v) for v in r], i) for r, i in zip(z, g)], "k string, z array<double>, g int")
    assert C.fit_temperature(df, ["k"]).first().temperature == pytest.approx(C.GRID[int(np.argmin(losses))])


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_samples_do_not_depend_on_partitioning(spark, n):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 7)).alias("family"))
    a = scale.take_by_hash(df.repartition(1), n, ["family"], ["row_id"], "s")
    b = scale.take_by_hash(df.repartition(37), n, ["family"], ["row_id"], "s")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert all(r["count"] == min(n, r.size) for r in a.groupBy("family").count().join(df.groupBy("family").agg(F.count("*").alias("size")), "family").collect())


def test_positions_and_running_totals_are_exact(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    pos = scale.hash_positions(df, ["g"], ["row_id"], "s")
    got = pos.groupBy("g").agg(F.countDistinct("position").alias("d"), F.count("*").alias("n"), F.max("position").alias("m")).collect()
    assert all(r.d == r.n and r.m == r.n - 1 for r in got)
    run = scale.running_totals(df, ["g"], "v", {"upto": "v"}).collect()
    for g in ("hot", "cold"):
        s = 0
        for r in sorted((r for r in run if r.g == g), key=lambda r: r.v):
            s += r.v
            assert r.upto == s
    down = scale.running_totals(df, ["g"], "v", {"upto": "v"}, descending=True).collect()
    s = 0
    for r in sorted((r for r in down if r.g == "hot"), key=lambda r: -r.v):
        s += r.v
        assert r.upto == s


def test_attach_gives_the_same_rows_salted_and_broadcast(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 9).alias("k"))
    dim = spark.range(6).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    facts = facts.withColumn("k", F.col("k").cast("int"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = scale.attach(facts, dim, ["k"], how, spread=["id"])
        b = scale.attach(facts, dim, ["k"], how, spread=["id"], max_rows=2)
        c = scale.attach(facts, dim, ["k"], how, max_rows=2)
        key = lambda r: (r[0], r[1], -1 if len(r) < 3 or r[2] is None else r[2])
        assert sorted(map(key, a.collect())) == sorted(map(key, b.select(a.columns).collect())) == sorted(map(key, c.select(a.columns).collect()))


def test_short_quota_is_an_error_unless_allowed(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.lit("a").alias("k"))
    with pytest.raises(ValueError, match="fewer rows"):
        K.quota_sample(df, {"a": 11}, "k", ["row_id"], "s")
    assert K.quota_sample(df, {"a": 11}, "k", ["row_id"], "s", strict=False).count() == 10


def test_unknown_family_has_no_weight(spark):
    df = spark.createDataFrame([("mystery", None)], "family string, generator string")
    with pytest.raises(Exception, match="no gold weight"):
        df.select(T.gold_weight("family", "generator")).collect()


def test_labels_and_limits(spark):
    assert one(spark, O.labels_for(F.lit(3))).c0 == ["A", "B", "C"]
    assert one(spark, O.labels_for(F.lit(27))).c0[-1] == "36"
    with pytest.raises(Exception, match="exceed"):
        one(spark, O.labels_for(F.lit(91)))


def test_long_context_never_uses_its_own_record(spark):
    rows = spark.range(30).select(F.concat(F.lit("r"), "id").alias("row_id"), F.lit('{"a":1}').alias("state"), F.col("id").alias("origin"))
    docs = spark.range(60).select(F.col("id").alias("record_id"), F.concat(F.lit("<"), F.col("id"), F.lit(">"), F.repeat(F.lit("x"), 300)).alias("text"))
    for r in V.long_context(rows, docs, 10, 1000, 2000).collect():
        assert f"<{r.origin}>" not in r.state and r.row_id.endswith("~long")
        assert r.state.startswith('{"a":1,"unrelated_context"')


def test_neutral_wording_fails_without_preamble(spark):
    df = spark.createDataFrame([("r1", "injection_x", "Something else")], "row_id string, family string, instructions string")
    with pytest.raises(Exception, match="without the expected preamble"):
        V.neutral_wording(df).collect()


def test_text_hash_ignores_case_and_any_whitespace(spark):
    r = one(spark, text_hash(F.lit("Ab  c\t\n d")), text_hash(F.lit("ab c d")), text_hash(F.lit(" ab c \x1f d ")))
    assert r.c0 == r.c1 == r.c2


def test_fixed_hash_arithmetic(spark):
    r = one(spark, hash_fraction(F.lit("x")), half(F.lit("x")))
    assert r.c0 == pytest.approx(0.17750681987439906, abs=1e-15) and r.c1 == 0x2d % 2


def test_rules(spark):
    t, f = F.lit(True), F.lit(False)
    r = one(spark, R.sla_breach(F.lit("P1"), F.lit(16), F.lit(0)), R.sla_breach(F.lit("P1"), F.lit(16), F.lit(1)), R.same_incident(F.lit("a"), F.lit("a"), F.lit("s"), F.lit("s"), F.lit(15)),
            R.churn_risk(F.lit(41), F.lit(0), F.lit(30)), R.incident_severity(F.lit(5.0), F.lit(0), t, f), R.invalid_field(F.lit("a@b.co"), F.lit("120"), F.lit("DE"), F.lit("2026-02-30")),
            R.repeats_a_call(F.array(*[F.lit(c) for c in "abbb"])), R.repeats_a_call(F.array(*[F.lit(c) for c in "abba"])), R.log_anomaly(F.array(F.lit("java.lang.OutOfMemoryError: x"))))
    assert tuple(r) == (True, False, True, 3, 2, "start_date", True, False, "oom")


def test_reply_and_key_helpers(spark):
    r = one(spark, text.answer_key(F.lit("  Héllo, World! ")), text.answer_key(F.lit("!!")), text.passage_question(F.lit("is it so?? ")), text.camel(F.lit("snake_case_key")),
            text.outermost_json(F.lit('x {"a": 1} y')), text.outermost_json(F.lit("{bad")))
    assert tuple(r) == ("héllo__world", "empty", "Is it so?", "snakeCaseKey", '{"a": 1}', None)
