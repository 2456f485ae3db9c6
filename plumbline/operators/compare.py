"""Paired comparison of runs, regression and non-inferiority gates, and reports between two tables of the same things."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mcnemar_p
from ..sources.tables import failed
from .metrics import comparable, latency_at_index, slice_mean_accuracy, with_correct
from .scale import attach, with_scalar

MIN_COVERAGE = 0.98
RULE_NET_LOSS_SHARE = 0.02
NON_INFERIORITY_MARGIN = 0.015
ALPHA = 0.05


def paired_rows(preds: DataFrame, base_run: str) -> DataFrame:
    """Every candidate's comparable case beside the base run's answer to the same case: one join for all candidates."""
    rows = with_correct(comparable(preds))  # one record per run and case, as the reader gives them
    base = rows.where(F.col("run_id") == base_run).select("case_id", "slice", F.col("correct").alias("base_correct"), F.col("pred").alias("base_pred"))
    cand = rows.where(F.col("run_id") != base_run).select("case_id", "run_id", "correct", "pred")
    return base.join(cand, "case_id")


def base_slices(preds: DataFrame, base_run: str) -> DataFrame:
    """Comparable cases of the base run per slice, with the number of slices; one row per slice."""
    sizes = comparable(preds).where(F.col("run_id") == base_run).groupBy("slice").agg(F.count(F.lit(1)).alias("n_base"))
    return sizes.withColumn("n_slices", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


def _lowest_share():
    """The lowest share over the base's slices; a slice without any shared case makes it zero."""
    return F.when(F.count(F.lit(1)) < F.max("n_slices"), F.lit(0.0)).otherwise(F.min(F.col("n") / F.col("n_base")))


def paired_counts(pairs: DataFrame, by: Sequence[str] = ("run_id",), slices: Sequence[str] | None = None) -> DataFrame:
    """n, newly wrong, newly right and the exact p value on the cases both answered."""
    rows = pairs
    if slices is not None:
        rows = rows.where(F.col("slice").isin(list(slices)))
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_correct") & ~F.col("correct")).alias("newly_wrong"),
                              F.count_if(~F.col("base_correct") & F.col("correct")).alias("newly_right"))
    return s.withColumn("p", mcnemar_p("newly_wrong", "newly_right")).withColumn(
        "accuracy_change", (F.col("newly_right") - F.col("newly_wrong")) / F.greatest(F.col("n"), F.lit(1)).cast("double"))


def coverage(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lowest per-slice share of the base run's cases that the candidate answered."""
    per = pairs.groupBy("run_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    return attach(per, sizes, ["slice"]).groupBy("run_id").agg(_lowest_share().alias("coverage"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Share of shared cases with the same prediction, case-sensitive."""
    return pairs.groupBy("run_id").agg(F.avg((F.col("pred") == F.col("base_pred")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def assess(preds: DataFrame, base_run: str, watched: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """One report row per candidate: accuracy, coverage, regression check, non-inferiority and eligibility under both rules.

    All of it comes from one set of slice sums, so the joined cases are read once. A run without any answered case does not
    appear; `missing_candidates` lists it.
    """
    pairs = paired_rows(preds, base_run)
    per = pairs.groupBy("run_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_correct") & ~F.col("correct")).alias("wrong"),
                                               F.count_if(~F.col("base_correct") & F.col("correct")).alias("right"))
    per = attach(per, base_slices(preds, base_run), ["slice"])
    watch = F.col("slice").isin(list(watched))
    part = lambda c: F.coalesce(F.sum(F.when(watch, F.col(c))), F.lit(0))
    s = per.groupBy("run_id").agg(
        _lowest_share().alias("coverage"), F.sum("n").alias("n"), F.sum("wrong").alias("newly_wrong"), F.sum("right").alias("newly_right"),
        part("n").alias("watched_n"), part("wrong").alias("watched_wrong"), part("right").alias("watched_right"))
    s = s.withColumn("p", mcnemar_p("newly_wrong", "newly_right"))
    s = s.withColumn("watched_net_loss", F.col("watched_wrong") - F.col("watched_right")).withColumn("watched_cap", F.lit(RULE_NET_LOSS_SHARE) * F.col("watched_n"))
    s = s.withColumn("regresses", ((F.col("newly_wrong") > F.col("newly_right")) & (F.col("p") < alpha)) | (F.col("watched_net_loss") > F.col("watched_cap")))
    s = s.withColumn("accuracy_change", (F.col("newly_right") - F.col("newly_wrong")) / F.greatest(F.col("n"), F.lit(1)).cast("double"))
    s = s.withColumn("non_inferior", F.col("accuracy_change") >= -NON_INFERIORITY_MARGIN)
    s = s.withColumn("eligible", (F.col("coverage") >= MIN_COVERAGE) & ~F.col("regresses"))
    s = s.withColumn("eligible_non_inferior", (F.col("coverage") >= MIN_COVERAGE) & F.col("non_inferior"))
    return s.join(F.broadcast(slice_mean_accuracy(preds).select("run_id", "mean_accuracy")), "run_id")  # one row per run


def assess_suites(preds: DataFrame, base_run: str, watched: Sequence[str], regression: str, accuracy: str, alpha: float = ALPHA) -> DataFrame:
    """The report over two suites: regressions are counted on one, accuracy on the other, coverage is the lower of both."""
    left = assess(preds.where(F.col("suite") == regression), base_run, watched, alpha).drop("mean_accuracy", "accuracy_change", "non_inferior", "eligible", "eligible_non_inferior")
    right = assess(preds.where(F.col("suite") == accuracy), base_run, watched, alpha)
    right = right.select("run_id", F.col("coverage").alias("_other"), "mean_accuracy", "accuracy_change", "non_inferior")
    both = left.join(right, "run_id").withColumn("coverage", F.least("coverage", "_other")).drop("_other")  # one row per run
    covered = F.col("coverage") >= MIN_COVERAGE
    return both.withColumn("eligible", covered & ~F.col("regresses")).withColumn("eligible_non_inferior", covered & F.col("non_inferior"))


def missing_candidates(preds: DataFrame, names: DataFrame) -> DataFrame:
    """Named candidates without one comparable answer: coverage 0, never eligible."""
    seen = comparable(preds).select("run_id").distinct()
    return names.join(seen, "run_id", "left_anti").withColumn("coverage", F.lit(0.0)).withColumn("eligible", F.lit(False))


def choose(report: DataFrame, eligible: str = "eligible") -> DataFrame:
    """The best eligible candidate, the least-regressing complete one when nobody is eligible, and which of the two it is."""
    complete = F.col("coverage") >= MIN_COVERAGE
    best = F.max_by("run_id", F.when(F.col(eligible), F.struct("mean_accuracy", "run_id")))
    fallback = F.max_by("run_id", F.when(complete, F.struct("accuracy_change", "mean_accuracy", "run_id")))
    s = report.agg(best.alias("best"), fallback.alias("fallback"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col(eligible)).alias("eligible"))
    return s.select("best", F.when(F.col("best").isNull(), F.col("fallback")).alias("fallback"), F.coalesce("best", "fallback").alias("chosen"), "candidates", "eligible")


def base_complete(preds: DataFrame, cases: DataFrame, base_run: str) -> DataFrame:
    """Whether the base run answered nearly every comparable case of each suite."""
    want = cases.where(F.col("task_type") != "score").groupBy("suite").agg(F.count(F.lit(1)).alias("n_cases"))
    got = comparable(preds).where(F.col("run_id") == base_run).groupBy("suite").agg(F.countDistinct("case_id").alias("n_answered"))
    rows = want.join(got, "suite", "left").withColumn("n_answered", F.coalesce("n_answered", F.lit(0)))
    return rows.withColumn("complete", F.col("n_answered") >= F.lit(MIN_COVERAGE) * F.col("n_cases"))


def gate_informative(report: DataFrame, control_run: str) -> DataFrame:
    """Positive control: the gate must flag a run whose regression is known."""
    c = report.where(F.col("run_id") == control_run)
    return c.select("run_id", ((F.col("coverage") >= MIN_COVERAGE) & F.col("regresses")).alias("informative"))


def canary(pairs: DataFrame, expected: int, threshold: float, min_share: float = MIN_COVERAGE) -> DataFrame:
    """Agreement above the threshold on nearly all expected cases."""
    return agreement(pairs).withColumn("expected", F.lit(expected)).withColumn(
        "passed", (F.col("n") >= F.lit(min_share) * F.col("expected")) & (F.col("agreement") >= threshold))


def labelling_complete(rows: DataFrame, labels: DataFrame, min_share: float = 0.98) -> DataFrame:
    """Labelled against wanted rows per family, and whether the whole passes."""
    ok = labels.where(~failed("error")).select("row_id").distinct().withColumn("ok", F.lit(1))
    s = rows.select("row_id").join(ok, "row_id", "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("ok").alias("labelled"))
    return s.withColumn("complete", F.col("labelled") >= F.lit(min_share) * F.col("wanted"))


def compare_by_family(old: DataFrame, new: DataFrame, value: str = "agreement") -> DataFrame:
    """Full outer join of two per-family tables, with where each family is present and the absolute difference."""
    o, n = old.select("family", F.col(value).alias("old")), new.select("family", F.col(value).alias("new"))
    rows = o.join(n, "family", "full_outer")
    place = F.when(F.col("old").isNull(), F.lit("only_new")).when(F.col("new").isNull(), F.lit("only_old")).otherwise(F.lit("common"))
    return rows.withColumn("place", place).withColumn("diff", F.abs(F.col("new") - F.col("old")))


def reproducibility(joined: DataFrame, worst: int = 5) -> DataFrame:
    """Families compared and on one side only, the largest difference and the few worst families."""
    s = joined.agg(F.count_if(F.col("place") == "common").alias("families_compared"), F.count_if(F.col("place") == "only_new").alias("families_only_new"),
                   F.count_if(F.col("place") == "only_old").alias("families_only_old"), F.max("diff").alias("max_difference"))
    top = joined.where(F.col("diff").isNotNull()).orderBy(F.desc("diff"), F.desc("family")).limit(worst)
    return with_scalar(s, top.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("diff", "family")))),
                                                               lambda w: w["family"]), ",").alias("worst")))


def scorer_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Largest probability difference, option key by option key, and share of equal answers of two scorers, per slice."""
    r = right.select("case_id", F.col("option_keys").alias("other_keys"), F.col("probs").alias("other_probs"), F.col("pred").alias("other_pred"))
    rows = left.join(r, "case_id").where(F.col("probs").isNotNull() & F.col("other_probs").isNotNull())
    at = lambda keys, probs, k: F.coalesce(F.get(probs, (F.array_position(keys, k) - 1).cast("int")), F.lit(0.0))
    every = F.array_union("option_keys", "other_keys")
    widest = F.array_max(F.transform(every, lambda k: F.abs(at(F.col("option_keys"), F.col("probs"), k) - at(F.col("other_keys"), F.col("other_probs"), k))))
    return rows.groupBy("slice").agg(F.max(widest).alias("max_difference"), F.avg((F.lower("pred") == F.lower("other_pred")).cast("double")).alias("same_top"),
                                     F.count(F.lit(1)).alias("n"))


def served_check(direct: DataFrame, served: DataFrame, min_same: float) -> DataFrame:
    """Same-answer share over all direct cases, the errors of the served side and its round trip: p50 and p95 of the sorted latencies by index."""
    s = served.select("case_id", F.col("pred").alias("served_pred"), F.col("error").alias("served_error"), F.col("latency_ms").alias("served_ms"))
    rows = direct.join(s, "case_id")
    out = rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.lower("served_pred") == F.lower("pred")).alias("same"),
                   F.count_if(failed("served_error")).alias("errors"))
    times = latency_at_index(rows.select(F.lit(0).alias("all"), F.col("served_ms").alias("latency_ms")), ["all"])
    out = with_scalar(out, times.agg(F.max("p50_ms").alias("p50_ms"), F.max("p95_ms").alias("p95_ms")))
    return out.select("p50_ms", "p95_ms", "cases", (F.col("same") / F.greatest(F.col("cases"), F.lit(1))).alias("same_top"), "errors",
                      ((F.col("cases") > 0) & (F.col("same") / F.greatest(F.col("cases"), F.lit(1)) >= min_same)).alias("passed"))


def best_over_slices(preds: DataFrame, slices: Sequence[str], default_run: str, min_gain: float = 0.04) -> DataFrame:
    """Best run over some slices, accepted only when it beats the default by a minimum gain."""
    acc = slice_mean_accuracy(preds.where(F.col("slice").isin(list(slices))))
    s = acc.agg(F.max_by("run_id", F.struct("mean_accuracy", "run_id")).alias("best"), F.max("mean_accuracy").alias("best_accuracy"),
                F.max(F.when(F.col("run_id") == default_run, F.col("mean_accuracy"))).alias("default_accuracy"))
    return s.withColumn("accepted", F.when(F.col("best_accuracy") >= F.col("default_accuracy") + min_gain, F.col("best")).otherwise(F.lit(default_run)))


def audit_claims(claims: DataFrame, measured: DataFrame, digits: int = 3) -> DataFrame:
    """Claimed figures that differ from the measured ones after rounding; claims are (run_id, metric, claimed)."""
    rows = claims.join(measured, ["run_id", "metric"], "left")
    return rows.withColumn("matches", F.coalesce(F.round("value", digits) == F.round("claimed", digits), F.lit(False)))


def shared_by_all_runs(preds: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Cases present in every named run, by counting runs per case instead of joining run by run."""
    rows = preds.where(F.col("run_id").isin(list(runs)))
    return rows.groupBy("case_id").agg(F.countDistinct("run_id").alias("_runs")).where(F.col("_runs") == len(runs)).select("case_id")

