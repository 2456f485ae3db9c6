"""Scores of prediction runs: one pass of map-side sums, then small follow-ups over the sums.

Definitions where the published score files leave room: Brier is (p - y)^2 for yes/no and the sum over options for choice;
the ranked probability score is divided by the number of levels less one; the best threshold is searched over the observed
probabilities; the bootstrap interval is the 2.5 and 97.5 percentile of resampled means.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import brier_sum, decision_loss, logits, one_hot, ranked_probability_score
from ..functions.resampling import poisson_weights, weights_of
from ..functions.stats import ece_bin, is_correct
from ..sources.tables import failed
from .scale import attach, materialise, running_totals, task_count, values_at, with_scalar

BY = ["run_id", "slice", "task_type"]
SKETCH_K = 800
SUMS_HELD, FAMILIES, CELLS = 512, 256, 4096  # of one task in the interval: 16 MB of sums, 4 MB of weights at 2,000 draws
INTERVAL_ROWS = 500_000  # of one task there; few tasks, as each sends a sum per run, slice and draw


def answered(preds: DataFrame) -> DataFrame:
    return preds.where(~failed("error") & F.col("pred").isNotNull())


def comparable(preds: DataFrame) -> DataFrame:
    """Answered yes/no and choice records: what accuracies and paired comparisons may use."""
    return answered(preds).where(F.col("task_type") != "score")


def with_correct(preds: DataFrame) -> DataFrame:
    return preds.withColumn("correct", is_correct("pred", "gold"))


def _mean(total: str, n: str = "n_scored"):
    return F.try_divide(F.col(total).cast("double"), F.col(n))


def slice_metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All additive metrics of every run and slice in one scan: sums per confidence bin, rolled up to the slice."""
    by = by or BY
    scored = ~failed("error") & F.col("pred").isNotNull()
    noul, score = F.col("task_type") == "noul", F.col("task_type") == "score"
    gold_true, said_true = F.lower("gold") == "true", F.lower("pred") == "true"
    p_gold = F.get("probs", (F.array_position("option_keys", F.col("gold")) - 1).cast("int"))
    y = F.when(gold_true, F.lit(1.0)).otherwise(F.lit(0.0))
    level, expected = F.col("gold").cast("double"), F.col("expected_level")
    hot = one_hot("option_keys", "gold")
    rows = preds.select(
        *by, F.when(scored, ece_bin("confidence")).alias("bin"), scored.alias("scored"), failed("error").alias("failed"),
        F.col("truncated").alias("truncated"), is_correct("pred", "gold").alias("correct"), "confidence", "p_true", "input_tokens",
        F.when(noul & scored, said_true & gold_true).alias("tp"), F.when(noul & scored, said_true & ~gold_true).alias("fp"),
        F.when(noul & scored, ~said_true & gold_true).alias("fn"), F.when(noul & scored, ~said_true & ~gold_true).alias("tn"),
        F.when(scored, F.when(noul, (F.col("p_true") - y) * (F.col("p_true") - y)).when(~score, brier_sum("probs", hot))).alias("brier"),
        F.when(scored & ~score, p_gold).alias("p_gold"),
        F.when(score & scored, F.abs(expected - level)).alias("abs_error"),
        F.when(score & scored, F.abs(F.round(expected) - level)).alias("abs_error_rounded"),
        F.when(score & scored, ranked_probability_score("probs", hot)).alias("rps"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    bins = rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n_cases"), count(F.col("scored")).alias("n_scored"), count(F.col("failed")).alias("n_errors"),
        count(F.col("truncated")).alias("n_truncated"), count(F.col("correct") & F.col("scored")).alias("n_correct"),
        F.sum("confidence").alias("sum_confidence"), *[count(F.col(k)).alias(k) for k in ("tp", "fp", "fn", "tn")],
        F.sum("brier").alias("sum_brier"), F.sum("p_true").alias("sum_p_true"),
        F.sum(F.when(F.col("p_gold") > 0, -F.log("p_gold"))).alias("sum_nll"), count(F.col("p_gold") > 0).alias("n_nll"),
        count(F.col("p_gold") == 0).alias("n_zero"),
        F.sum(F.when(F.col("p_gold").isNotNull(), -F.log(F.greatest("p_gold", F.lit(1e-12))))).alias("sum_nll_clipped"),
        F.sum("abs_error").alias("sum_abs_error"), F.sum("abs_error_rounded").alias("sum_abs_error_rounded"),
        count(F.col("abs_error_rounded") == 0).alias("n_exact"), count(F.col("abs_error_rounded") <= 1).alias("n_within_one"),
        F.sum("rps").alias("sum_rps"), F.sum("input_tokens").alias("tokens"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("n_correct") - F.col("sum_confidence")))
    sums = [c for c in bins.columns if c not in (*by, "bin")]
    s = bins.groupBy(*by).agg(F.sum(gap).alias("sum_gap"), *[F.sum(c).alias(c) for c in sums])
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    only = lambda kind, c: F.when(F.col("task_type") == kind, c)
    not_score = lambda c: F.when(F.col("task_type") != "score", c)
    return s.select(
        *by, "n_cases", "n_errors", "n_scored", "n_truncated", _mean("n_scored", "n_cases").alias("coverage"),
        not_score(_mean("n_correct")).alias("accuracy"), only("noul", 1.0 - _mean("n_correct")).alias("accuracy_if_flipped"),
        not_score(_mean("sum_gap")).alias("ece_10_bins"),
        only("noul", precision).alias("precision"), only("noul", recall).alias("recall"),
        only("noul", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        only("noul", F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn"))).alias("false_positive_rate"),
        *[only("noul", F.col(k)).alias(k) for k in ("tp", "fp", "fn", "tn")],
        not_score(_mean("sum_brier")).alias("brier"), not_score(_mean("sum_nll", "n_nll")).alias("nll_excluding_zeros"),
        not_score(F.col("n_zero")).alias("n_zero_on_gold"), not_score(_mean("sum_nll_clipped")).alias("nll_clipped"),
        only("noul", _mean("sum_p_true")).alias("mean_p_true"),
        only("noul", F.try_divide((F.col("tp") + F.col("fn")).cast("double"), F.col("n_scored"))).alias("base_rate"),
        only("score", _mean("sum_abs_error")).alias("mae_expected_level"), only("score", _mean("sum_abs_error_rounded")).alias("mae_rounded"),
        only("score", _mean("n_exact")).alias("exact_accuracy"), only("score", _mean("n_within_one")).alias("within_one_level"),
        only("score", _mean("sum_rps")).alias("ranked_probability_score"),
        F.try_divide(F.col("tokens").cast("double"), F.col("n_cases")).alias("input_tokens_mean"), F.col("tokens").alias("input_tokens_total"))


def headline(metrics: DataFrame) -> DataFrame:
    """Accuracy per slice, the mean error of the expected level for ordinals; ECE beside it; a tag when cases are missing."""
    value = F.when(F.col("task_type") == "score", F.col("mae_expected_level")).otherwise(F.col("accuracy"))
    tag = F.when(F.col("coverage") < 1, F.concat(F.format_string("%.0f", F.col("coverage") * 100), F.lit("% cov")))
    return metrics.select("run_id", "slice", "task_type", F.when(F.col("task_type") == "score", F.lit("mae_expected_level")).otherwise(
        F.lit("accuracy")).alias("metric"), value.alias("value"), F.col("ece_10_bins").alias("ece"), "coverage", tag.alias("coverage_tag"))


def leaderboard(head: DataFrame) -> DataFrame:
    """Mean accuracy and ECE per run, only where every accuracy slice is present; input is one row per run and slice."""
    acc = F.when(F.col("task_type") != "score", F.col("value"))
    runs = head.groupBy("run_id").agg(
        F.count(acc).alias("n_slices"), F.avg(acc).alias("acc"), F.count("ece").alias("n_ece"), F.avg("ece").alias("mean_ece"),
        F.bool_or((F.col("task_type") != "score") & (F.col("coverage") < 1)).alias("partial"))
    most = F.max("n_slices").over(Window.partitionBy(F.lit(0)))  # one row per run
    return runs.withColumn("expected_slices", most).select(
        "run_id", "expected_slices", F.when(F.col("n_slices") == F.col("expected_slices"), F.col("acc")).alias("mean_accuracy"),
        F.when(F.col("n_ece") == F.col("expected_slices"), F.col("mean_ece")).alias("mean_ece"), "partial")


def scoreboard_matrix(head: DataFrame, runs: list[str]) -> DataFrame:
    """Slices down, runs across."""
    return head.groupBy("slice", "task_type").pivot("run_id", runs).agg(F.first("value"))


def class_metrics(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class of choice slices; a class is any gold or predicted key."""
    rows = comparable(preds).where(F.col("task_type") == "choice")
    hit = (F.col("pred") == F.col("gold")).cast("int")
    sides = rows.select("run_id", "slice", F.explode(F.array(
        F.struct(F.col("gold").alias("key"), F.lit(1).alias("support"), F.lit(0).alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("key"), F.lit(0).alias("support"), F.lit(1).alias("predicted"), F.lit(0).alias("tp")))).alias("c"))
    agg = sides.groupBy("run_id", "slice", F.col("c.key").alias("class")).agg(
        F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return agg.select("run_id", "slice", "class", "support", ratio("tp", F.col("predicted")).alias("precision"),
                      ratio("tp", F.col("support")).alias("recall"),
                      F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0)).alias("f1"))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.groupBy("run_id", "slice").agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def _score_counts(preds: DataFrame) -> DataFrame:
    rows = answered(preds).where(F.col("task_type") == "noul")
    pos = F.count_if(F.lower("gold") == "true")
    return rows.groupBy("run_id", "slice", "p_true").agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))


def ranking_metrics(preds: DataFrame) -> DataFrame:
    """AUROC (ties count half) and the best threshold with its accuracy, from counts per distinct probability.

    Equal probabilities collapse before anything is ordered, and the cumulative counts run block by block.
    """
    counts = materialise(_score_counts(preds), "scores")
    run = running_totals(counts, ["run_id", "slice"], "p_true", {"pos_upto": "pos", "neg_upto": "neg"})
    sizes = counts.groupBy("run_id", "slice").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    rows = attach(run, sizes, ["run_id", "slice"], spread=["p_true"])
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0)
    right = F.col("n_pos") - F.col("pos_upto") + F.col("pos") + F.col("neg_upto") - F.col("neg")
    best = F.max(F.struct(right.alias("right"), (-F.col("p_true")).alias("minus_t")))
    out = rows.groupBy("run_id", "slice").agg(F.sum(won).alias("won"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), best.alias("best"))
    return out.select("run_id", "slice", F.try_divide(F.col("won"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auroc"),
                      (-F.col("best.minus_t")).alias("best_threshold"),
                      (F.col("best.right").cast("double") / (F.col("n_pos") + F.col("n_neg"))).alias("best_threshold_accuracy"))


def position_bias(preds: DataFrame) -> DataFrame:
    """Accuracy by option order, and how often correctness changes between the two orders of a family."""
    rows = with_correct(comparable(preds))
    ok = lambda kind: F.bool_or(F.when(F.col("perturbation") == kind, F.col("correct")))
    families = rows.groupBy("run_id", "slice", "family_id").agg(
        ok("none").alias("plain"), ok("permuted").alias("permuted"),
        *[F.count_if((F.col("perturbation") == k) & f).alias(a) for k, f, a in (
            ("none", F.lit(True), "n0"), ("permuted", F.lit(True), "n1"), ("none", F.col("correct"), "c0"), ("permuted", F.col("correct"), "c1"))])
    both = F.col("plain").isNotNull() & F.col("permuted").isNotNull()
    s = families.groupBy("run_id", "slice").agg(
        F.count_if(both).alias("n_families_with_both"), F.count_if(F.col("plain") & F.col("permuted")).alias("both_right"),
        F.count_if(F.col("plain") != F.col("permuted")).alias("flipped"), *[F.sum(c).alias(c) for c in ("n0", "n1", "c0", "c1")])
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return s.where(F.col("n_families_with_both") > 0).select(
        "run_id", "slice", ratio("c0", "n0").alias("accuracy_none"), ratio("c1", "n1").alias("accuracy_permuted"), "n_families_with_both",
        ratio("both_right", "n_families_with_both").alias("both_variants_correct"), ratio("flipped", "n_families_with_both").alias("flipped_by_reordering"))


def runtime(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Latency percentiles (interpolated p50, p95, p99) without holding a group's values in one place, tokens and retries.

    Rows without latency count for tokens and retries; a group without any latency has no percentiles.
    """
    by = by or ["run_id", "slice"]
    at = lambda q, up: (F.ceil if up else F.floor)((F.col("n") - 1) * F.lit(q)).cast("bigint")
    qs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    picks = values_at(preds.select(*by, "latency_ms"), by, "latency_ms",
                      {f"{k}_{s}": at(q, s == "hi") for k, q in qs.items() for s in ("lo", "hi")})
    frac = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    found = picks.select(*by, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * frac(q)).alias(f"latency_ms_{k}") for k, q in qs.items()])
    sums = preds.groupBy(*by).agg(*_usage(preds))
    return sums.join(found, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[f"latency_ms_{k}" for k in qs], *_usage_figures())


def _usage(preds: DataFrame) -> list[Column]:
    again = F.sum("retries") if "retries" in preds.columns else F.lit(None)
    return [F.count("input_tokens").alias("with_tokens"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"), F.coalesce(again, F.lit(0)).cast("bigint").alias("retries")]


def _usage_figures() -> list[Column]:
    return [F.try_divide(F.col("tokens").cast("double"), F.col("with_tokens")).alias("input_tokens_mean"), F.col("tokens").alias("input_tokens_total"), "retries"]


def runtime_summaries(preds: DataFrame, by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """One mergeable row per group: a KLL sketch of the latencies beside exact counts and sums.

    A sketch has a size bounded by k whatever the group's size; with k = 800 a rank is off by less than 0.5 % of the rows.
    """
    by = by or ["run_id", "slice"]
    return preds.groupBy(*by).agg(F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch"), F.count("latency_ms").alias("n"), *_usage(preds))


def merged_summaries(summaries: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Stored summaries of any parts of a group as one: the runs themselves are not read again."""
    sums = [F.sum(c).alias(c) for c in ("n", "with_tokens", "tokens", "retries")]
    return summaries.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), *sums)


def runtime_from_summaries(summaries: DataFrame, by: list[str]) -> DataFrame:
    """The columns of `runtime` out of summaries, the percentiles within the sketch's rank error."""
    qs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    value = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return summaries.select(*by, "n", *[value(q).alias(f"latency_ms_{name}") for name, q in qs.items()], *_usage_figures())


def rank_errors(preds: DataFrame, estimates: DataFrame, by: list[str], names: dict[str, float]) -> DataFrame:
    """How far the share of values below and up to each estimate is from its quantile, per group."""
    rows = attach(preds.where("latency_ms IS NOT NULL").select(*by, "latency_ms"), estimates.select(*by, *names), by, spread=["latency_ms"])
    share = lambda cond: F.avg(cond.cast("double"))
    off = [F.greatest(share(F.col("latency_ms") < F.col(c)) - F.lit(q), F.lit(q) - share(F.col("latency_ms") <= F.col(c)), F.lit(0.0)).alias(f"{c}_off") for c, q in names.items()]
    return rows.groupBy(*by).agg(*off)


def order_and_latency(preds: DataFrame) -> DataFrame:
    """Run by slice: answers changed by reordering (per mille of the families) and median latency, `n/a` where a run lacks the slice."""
    runs = preds.agg(F.collect_set("run_id").alias("runs"))  # the compared runs
    every = with_scalar(preds.select("slice").distinct(), runs).select(F.explode("runs").alias("run_id"), "slice")
    shown = lambda c: F.coalesce(F.floor(F.col(c) + 0.5).cast("bigint").cast("string"), F.lit("n/a"))
    flips = position_bias(preds).select("run_id", "slice", (F.col("flipped_by_reordering") * 1000).alias("flipped"))
    times = latency_at_index(preds, ["run_id", "slice"]).select("run_id", "slice", "p50_ms")
    both = every.join(flips, ["run_id", "slice"], "left").join(times, ["run_id", "slice"], "left")
    return both.select("run_id", "slice", shown("flipped").alias("flipped_permille"), shown("p50_ms").alias("p50_ms"))


def latency_at_index(rows: DataFrame, by: list[str]) -> DataFrame:
    """p50 as the value at n // 2 and p95 as the value at max(0, int(0.95 n) - 1) of the sorted latencies."""
    n = F.col("n")
    return values_at(rows.select(*by, "latency_ms"), by, "latency_ms", {
        "p50_ms": F.floor(n / 2).cast("bigint"),
        "p95_ms": F.greatest(F.lit(0), F.floor(n * F.lit(0.95)).cast("bigint") - 1)})


def bootstrap_interval(preds: DataFrame, resamples: int = 2000, seed="bootstrap") -> DataFrame:
    """95% interval of the headline, resampling whole families with Poisson(1) weights drawn from a hash.

    Cases shrink to family sums first, in the task that draws the family: families are many and mostly small, so no sums are
    built before the shuffle. A family's weights are drawn once for all runs and slices, eight out of one digest, and travel with
    its first row; a task keeps only the weighted sums of each run and slice, as arrays with a place per draw, and the tasks'
    arrays are added up. Records without a family take no part. The records are counted first, so hand in a table that is cheap
    to count.
    """
    score = F.col("task_type") == "score"
    value = F.when(score, F.abs(F.col("expected_level") - F.col("gold").cast("double"))).otherwise(is_correct("pred", "gold").cast("double"))
    cores = task_count(preds)
    tasks = cores * max(1, -(-preds.count() // (cores * INTERVAL_ROWS)))
    rows = answered(preds).where("family_id IS NOT NULL").select("run_id", "slice", "family_id", value.alias("value"))
    near = rows.repartition(tasks, "family_id").groupBy("run_id", "slice", "family_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    types = {f.name: f.dataType.simpleString() for f in near.schema}
    if types["family_id"] in ("string", "tinyint", "smallint", "int", "bigint"):
        first = F.row_number().over(Window.partitionBy("family_id").orderBy("run_id", "slice")) == 1
        w = poisson_weights(preds.sparkSession, "family_id", resamples, str(seed))
        near = near.withColumn("first", first).select("run_id", "slice", "s", "n", F.when(F.col("first"), w).alias("w"))
    else:
        near = near.sortWithinPartitions("family_id")
    drawn = near.mapInArrow(partial(_weighted_sums, resamples=resamples, seed=str(seed)), f"run_id {types['run_id']}, slice {types['slice']}, s array<double>, n array<double>, known boolean")
    each = drawn.select("run_id", "slice", "known", F.posexplode(F.arrays_zip("s", "n")).alias("draw", "w"))
    means = each.groupBy("run_id", "slice", "draw").agg(F.when(F.bool_or("known"), F.try_divide(F.sum("w.s"), F.sum("w.n"))).alias("m"))
    ends = means.groupBy("run_id", "slice").agg(F.percentile("m", [0.025, 0.975]).alias("q"))  # `resamples` values a group
    return ends.select("run_id", "slice", F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"))


def _weighted_sums(batches, resamples: int, seed: str):
    """Per run and slice the sums of weight * s and weight * n of every draw, of rows sorted by family.

    A family's first row has its weights in `w`; without that column they are drawn here, of family_id. FAMILIES families at a
    time are a matrix of weights, which all their cells are multiplied by at once; the sums go out when more than SUMS_HELD runs
    and slices are held.
    """
    held, kinds, last, name = {}, [], bytes(resamples), None  # last: the weights of the family that goes on in the next batch

    def add(keys, which, family, s, n, known, weights):
        at, cells = which * len(weights) + family, len(keys) * len(weights)
        both = np.concatenate([np.bincount(at, v, cells) for v in (s, n)]).reshape(2 * len(keys), -1) @ weights.astype(float)
        known = np.bincount(which, known, len(keys)) > 0
        for g, key in enumerate(keys):
            sums = held.setdefault(key, [0.0, 0.0, False])
            sums[:] = [sums[0] + both[g], sums[1] + both[len(keys) + g], sums[2] or bool(known[g])]

    def drawn(batch):
        """Whether a family starts at a row, and the weights of the families that start."""
        nonlocal name
        if "w" in batch.schema.names:
            w = batch.column("w")
            return w.is_valid().to_numpy(zero_copy_only=False), w.drop_null().to_pylist()
        families = [name, *batch.column("family_id").to_pylist()]
        name = families[-1]
        starts = np.array([a != b for a, b in zip(families, families[1:])], dtype=bool)
        return starts, [weights_of(f, resamples, seed) for f, start in zip(families[1:], starts) if start]

    def out():
        keys, sums, lists = list(held), list(held.values()), pa.list_(pa.float64())
        names = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*names, pa.array([x[0] for x in sums], lists), pa.array([x[1] for x in sums], lists), pa.array([x[2] for x in sums], pa.bool_())],
                                          names=["run_id", "slice", "s", "n", "known"])

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in ("run_id", "slice")]
        runs, parts = (pc.dictionary_encode(batch.column(c), null_encoding="encode") for c in ("run_id", "slice"))
        run_names, part_names = runs.dictionary.to_pylist(), parts.dictionary.to_pylist()
        group = runs.indices.to_numpy().astype(np.int64) * len(part_names) + parts.indices.to_numpy()
        known = batch.column("s").is_valid().to_numpy(zero_copy_only=False)
        s, n = pc.fill_null(batch.column("s"), 0).to_numpy(), batch.column("n").to_numpy()
        starts, weights = drawn(batch)
        family, weights = np.cumsum(starts), [last, *weights]
        last = weights[-1]
        weights = np.frombuffer(b"".join(weights), np.uint8).reshape(len(weights), resamples)
        at = 0
        while at < len(group):
            end = min(at + CELLS, int(np.searchsorted(family, family[at] + FAMILIES)))
            rows = slice(at, end)
            found, which = np.unique(group[rows], return_inverse=True)
            keys = [(run_names[k // len(part_names)], part_names[k % len(part_names)]) for k in found]
            add(keys, which, family[rows] - family[at], s[rows], n[rows], known[rows], weights[family[at]:family[end - 1] + 1])
            at = end
            if len(held) > SUMS_HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def decision_losses(rows: DataFrame) -> DataFrame:
    """Mean training loss and accuracy per family and task type of (probs, target) rows."""
    loss = decision_loss(logits("probs"), "target", "task_type")
    return rows.groupBy("family", "task_type").agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def macro_by_family(rows: DataFrame) -> DataFrame:
    """Validation accuracy per family, then their plain mean: rows (split, family, correct)."""
    fam = rows.groupBy("split", "family").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return fam.groupBy("split").agg(F.avg("acc").alias("acc_macro"), F.count(F.lit(1)).alias("n_families"))


def slice_mean_accuracy(preds: DataFrame) -> DataFrame:
    per = with_correct(comparable(preds)).groupBy("run_id", "slice").agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("run_id").agg(F.avg("acc").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_slices"), F.sum("n").alias("n"))


def labelling_throughput(labels: DataFrame) -> DataFrame:
    """Rows, errors, tokens and rates of label tables; seconds is the summed latency."""
    ok = ~failed("error")
    s = labels.groupBy("teacher").agg(F.count_if(ok).alias("labelled"), F.count_if(~ok).alias("errors"), F.sum(F.when(ok, F.col("input_tokens"))).alias("tokens"),
                                      (F.sum(F.when(ok, F.col("latency_ms"))) / 1000.0).alias("seconds"))
    return s.select("*", F.try_divide(F.col("labelled").cast("double"), F.col("seconds")).alias("rows_per_s"),
                    F.try_divide(F.col("tokens").cast("double"), F.col("seconds")).alias("tokens_per_s"))


def distribution_counts(rows: DataFrame) -> DataFrame:
    """Rows by family, type, gold and option count."""
    return rows.groupBy("family", "task_type", "gold", "n_options").count().withColumnRenamed("count", "n")
