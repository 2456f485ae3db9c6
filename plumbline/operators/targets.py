"""Soft training targets: calibrated teacher probabilities blended with the gold answer."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import half, held_out
from ..functions.options import keys_of
from ..functions.probability import argmax, blend, let, one_hot
from ..sources.tables import last_wins
from . import calibration as C
from .guards import remaining
from ..sources.tables import failed
from .scale import attach, materialise

# Families by how reliable their gold answers are, and the weight the gold answer gets in each class.
OBJECTIVE = ["arc_science", "csqa_commonsense", "aqua_math", "dbpedia_topic", "clinc_intent", "massive_intent", "boolq_passage_qa"]
SUBJECTIVE = ["civil_toxicity", "snli_nli", "wanli_nli"]
WEIGHT_GENERATED, WEIGHT_COLLECTION, WEIGHT_RULE, WEIGHT_OBJECTIVE, WEIGHT_SUBJECTIVE = 0.7, 0.6, 0.9, 0.7, 0.5
GENERATED_PREFIX, COLLECTION_PREFIX = "syn_", "sni_"
CONFLICT, MIN_FAMILY, CONSENSUS = 0.1, 100, 0.5
# The default calibration of a family without enough rows of its own.
DEFAULT_CALIBRATION = {"choice": 1.0, "score": 1.0, "noul": (1.0, 0.0)}


def gold_weight(family: str = "family", generator: str = "provenance.generator") -> Column:
    f = F.col(family)
    unknown = F.raise_error(F.concat(F.lit("no gold weight defined for family "), f)).cast("double")
    return (F.when(f.startswith(GENERATED_PREFIX), F.lit(WEIGHT_GENERATED)).when(f.startswith(COLLECTION_PREFIX), F.lit(WEIGHT_COLLECTION))
            .when(F.coalesce(F.col(generator), F.lit("")) != "", F.lit(WEIGHT_RULE)).when(f.isin(OBJECTIVE), F.lit(WEIGHT_OBJECTIVE))
            .when(f.isin(SUBJECTIVE), F.lit(WEIGHT_SUBJECTIVE)).otherwise(unknown))


def usable_labels(labels: DataFrame, order: str = "load_order") -> DataFrame:
    """Labels without an error, the latest of a row winning."""
    ok = labels.where(~failed("error")).select("row_id", "probs", "teacher", order)
    return last_wins(ok, ["row_id"], order).drop(order)


def unlabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """How many rows have no usable label, by family."""
    left = remaining(rows.select("row_id", "family"), labels.where(~failed("error")), "row_id")
    return left.groupBy("family").agg(F.count(F.lit(1)).alias("missing"))


def cross_fit_families(items: DataFrame, min_family: int = MIN_FAMILY, default: dict | None = None) -> DataFrame:
    """Calibrated distribution per row: fitted on the other fold of its family and type, or the defaults when too small."""
    d = default or DEFAULT_CALIBRATION
    keys = ["family", "fold", "task_type"]
    trained = C.fit(items.withColumn("fold", F.lit(1) - F.col("fold")), ["family", "fold"]).where(F.col("n") >= min_family // 2)
    rows = attach(items, trained.select(*keys, "temperature", "a", "b"), keys, "left", spread=["row_id"])
    t = F.coalesce("temperature", F.when(F.col("task_type") == "choice", F.lit(float(d["choice"]))).otherwise(F.lit(float(d["score"]))))
    a, b = F.coalesce("a", F.lit(float(d["noul"][0]))), F.coalesce("b", F.lit(float(d["noul"][1])))
    return rows.withColumn("temperature", t).withColumn("a", a).withColumn("b", b).withColumn("calibrated", C.apply())


def label_table(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Decision rows with their teacher's log-probabilities and fold, written once: fitting and applying both read it.

    Only the columns that the calibration needs are written; the state joins back in `targets`.
    """
    items = C.label_items(rows.select("row_id", "family", "task_type", "options", "gold", "holdout_family", F.col("provenance.generator").alias("generator")),
                          usable_labels(labels))
    return materialise(items.withColumn("fold", half("row_id")).drop("options", "probs"), "labelled")


def consensus(items: DataFrame) -> DataFrame:
    """Share of rows per generated family on which the teacher's answer is the gold answer."""
    gen = items.where(F.col("family").startswith(GENERATED_PREFIX))
    return gen.groupBy("family").agg(F.avg((argmax("z") == F.col("g")).cast("double")).alias("consensus"))


def targets(items: DataFrame, min_family: int = MIN_FAMILY, conflict: float = CONFLICT, default: dict | None = None) -> DataFrame:
    """Target rows: generated rows without consensus dropped (a whole family below half), calibrated, blended, flagged."""
    agree = argmax("z") == F.col("g")
    generated = F.col("family").startswith(GENERATED_PREFIX)
    cal = cross_fit_families(items, min_family, default)
    cal = attach(cal, consensus(items), ["family"], "left", spread=["row_id"])
    kept = cal.where(~generated | ((F.col("consensus") >= CONSENSUS) & agree))
    w = gold_weight("family", "generator")
    return kept.select(
        "row_id", "family", "task_type", "keys", "gold", "g", "teacher", w.alias("gold_weight"),
        let(one_hot("keys", "gold"), lambda hot: blend(w, hot, "calibrated")).alias("target"),
        F.transform("calibrated", lambda p: F.round(p, 6)).alias("teacher_calibrated"),
        (F.get("calibrated", F.col("g")) < F.lit(conflict)).alias("teacher_conflict"), (argmax("calibrated") == F.col("g")).alias("agrees"),
        (F.coalesce("holdout_family", F.lit(False)) | (generated & held_out("family"))).alias("holdout_family"))


def target_report(items: DataFrame, out: DataFrame) -> DataFrame:
    """Rows, teacher = gold, conflicts and dropped rows per family."""
    n = items.groupBy("family").agg(F.count(F.lit(1)).alias("labelled"))
    t = out.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("agrees").cast("double")).alias("agreement"), F.count_if("teacher_conflict").alias("conflicts"))
    j = n.join(t, "family", "left").fillna({"rows": 0, "agreement": 0.0, "conflicts": 0})
    return j.select("family", "rows", "agreement", "conflicts", (F.col("labelled") - F.col("rows")).alias("dropped"))


def with_target_columns(rows: DataFrame, out: DataFrame) -> DataFrame:
    """The full decision rows of the kept targets, state and question included: one join on the unique row id."""
    return rows.drop("holdout_family", "gold", "family", "task_type").join(out.drop("keys", "g", "agrees"), "row_id")


def concatenate(core: DataFrame, *fixed: DataFrame) -> DataFrame:
    """Regenerated core rows followed by rows that are kept as they are."""
    out = core
    for f in fixed:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def smoothed_detection_targets(rows: DataFrame, weight: float = 0.9) -> DataFrame:
    """Rows without a teacher: the gold answer smoothed, as for rule labels."""
    from ..functions.probability import smoothed
    return rows.withColumn("target", smoothed(keys_of("options"), "gold", weight)).withColumn("gold_weight", F.lit(weight)).withColumn("teacher", F.lit(None).cast("string"))


