"""New prediction records out of token log-probabilities, several orders, several runs or one parsed reply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import labels_for
from ..functions.probability import clean_tokens, from_logprobs, from_map, let, mean_distribution, normalise, two_digit
from ..sources.derived import with_answers
from ..sources.tables import failed


def records_from_logprobs(rows: DataFrame) -> DataFrame:
    """Distribution and label mass out of the top tokens of one call per case: (option_keys, top map)."""
    labels = labels_for(F.size("option_keys"))
    read = rows.withColumn("_d", let(clean_tokens("top"), lambda m: from_logprobs(m, labels)))
    return with_answers(read.withColumn("probs", F.col("_d.probs")).withColumn("label_mass", F.col("_d.mass")).drop("_d"))


def records_from_codes(rows: DataFrame) -> DataFrame:
    """The same for two-digit codes: (option_keys, top map, second: map of first digit to token map).

    When the codes themselves hold more than half the mass they are read as whole tokens.
    """
    labels = labels_for(F.size("option_keys"))
    whole = F.aggregate(labels, F.lit(0.0), lambda a, k: a + F.coalesce(F.exp(F.try_element_at("top", k)), F.lit(0.0)))
    read = rows.withColumn("_d", F.when(whole > 0.5, from_logprobs("top", labels)).otherwise(two_digit("top", "second", labels)))
    return with_answers(read.withColumn("probs", F.col("_d.probs")).withColumn("label_mass", F.col("_d.mass")).drop("_d"))


def record_from_reply(rows: DataFrame, label: str) -> DataFrame:
    """One-hot distribution on the option of a parsed label; an unparsed reply becomes an error."""
    labels = labels_for(F.size("option_keys"))
    hot = F.transform(labels, lambda k: F.when(k == F.col(label), F.lit(1.0)).otherwise(F.lit(0.0)))
    read = rows.withColumn("probs", F.when(F.col(label).isNotNull(), hot)).withColumn("error", F.when(F.col(label).isNull(), F.lit("unparseable reply")))
    return with_answers(read)


def ensemble(preds: DataFrame, runs: Sequence[str], run_id: str) -> DataFrame:
    """Mean distribution over runs per case: one aggregate by case, no join per run.

    The runs hold one record per case (the reader keeps the last); a second one stops the job.
    Only cases present in every run count, and a case with an error or no answer in any of them drops. Keys follow the first
    run's order; latencies add up.
    """
    rows = preds.where(F.col("run_id").isin(list(runs))).withColumn("_order", F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run_id")))
    carry = [c for c in ("suite", "family_id", "slice", "source", "task_type", "perturbation", "n_options", "gold", "truncated", "option_keys", "input_tokens") if c in preds.columns]
    bad = failed("error") | F.col("pred").isNull()
    g = rows.groupBy("case_id").agg(
        F.countDistinct("run_id").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.count_if(bad).alias("_bad"), F.min_by(F.struct(*carry), "_order").alias("f"), F.sum("latency_ms").alias("latency_ms"),
        F.collect_list(F.struct("_order", "option_keys", "probs")).alias("members"))  # one entry per run
    twice = F.raise_error(F.concat(F.lit("more than one record of a run for case "), F.col("case_id"))).cast("bigint")
    g = g.withColumn("_n", F.when(F.col("_rows") == F.col("_n"), F.col("_n")).otherwise(twice))
    whole = g.where((F.col("_n") == len(runs)) & (F.col("_bad") == 0)).select("case_id", "f.*", "latency_ms", F.array_sort("members").alias("members"))
    at = lambda m, k: F.get(m["probs"], (F.array_position(m["option_keys"], k) - 1).cast("int"))
    mean = F.transform("option_keys", lambda k: F.aggregate("members", F.lit(0.0), lambda a, m: a + at(m, k)) / F.lit(float(len(runs))))
    out = whole.withColumn("probs", mean).drop("members").withColumn("run_id", F.lit(run_id)).withColumn("error", F.lit(None).cast("string"))
    return with_answers(out)


def average_orders(rows: DataFrame, n: int, how: str, run_id: str | None = None) -> DataFrame:
    """Average a case over its first n option orders: rows (case_id, option_keys, orders array of (order, by_key map), error).

    Every order's map is read in the key order of the first one; errors pass through without an answer.
    """
    name = run_id or (f"orders-n{n}" if n == 1 else f"orders-n{n}-{how}")
    dists = F.transform(F.slice("orders", 1, n), lambda o: from_map(o["by_key"], "option_keys"))
    out = rows.withColumn("probs", F.when(F.col("error").isNull(), mean_distribution(dists, how))).withColumn("run_id", F.lit(name)).drop("orders")
    return with_answers(out)


def served_two_orders(rows: DataFrame) -> DataFrame:
    """Serving with two orders: choice questions average the given and the reversed order, others keep the first."""
    two = F.transform(F.slice("orders", 1, 2), lambda o: from_map(o["by_key"], "option_keys"))
    one = F.get(two, F.lit(0))
    return rows.withColumn("probs", F.when(F.col("task_type") == "choice", mean_distribution(two, "arith")).otherwise(normalise(one)))
