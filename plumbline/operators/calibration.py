"""Calibrators fitted for every group in one job: temperatures on a fixed grid, Platt scaling by Newton steps.

Input rows carry the group columns and, for a temperature, `z` (log-probabilities) and `g` (gold position); for Platt scaling
`x` (log-odds) and `y` (0 or 1). Groups are never collected: temperatures come from one scan that sums every grid point, and a
round of Platt scaling is a map-side aggregate over all rows, with the few parameters of a group attached.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import half
from ..functions.options import keys_of
from ..functions.probability import from_map, let, logits, platt, softmax
from ..functions.stats import ece_bin
from ..sources.tables import failed
from .scale import attach, fits_broadcast, materialise, spread

# 200 temperatures, evenly spaced in log from 0.25 to 50.
GRID_SIZE, GRID_LOW, GRID_HIGH = 200, 0.25, 50.0
GRID = [math.exp(math.log(GRID_LOW) + (math.log(GRID_HIGH) - math.log(GRID_LOW)) * i / (GRID_SIZE - 1)) for i in range(GRID_SIZE)]
GROUPS_HELD, VALUES = 4096, 2048  # of one task: 6.5 MB of sums, a matrix of 3.3 MB
RIDGE = 1e-2
MIN_SLICE_ROWS = 20
POOLED = "*"


def items(preds: DataFrame) -> DataFrame:
    """Prediction records with their log-probabilities and gold position; records without an answer or a usable gold drop."""
    ok = preds.where(~failed("error") & F.col("pred").isNotNull())
    noul = F.col("task_type") == "noul"
    p = F.least(F.greatest(F.col("p_true"), F.lit(1e-15)), F.lit(1 - 1e-15))
    z = F.when(noul, F.array(F.log(F.lit(1.0) - p), F.log(p))).otherwise(logits("probs"))
    g = F.when(noul, (F.lower("gold") == "true").cast("int")).otherwise((F.array_position("option_keys", F.col("gold")) - 1).cast("int"))
    rows = ok.withColumn("z", z).withColumn("g", g).where(F.col("g") >= 0)
    return rows.withColumn("x", F.when(noul, F.get("z", F.lit(1)) - F.get("z", F.lit(0)))).withColumn("y", F.when(noul, F.col("g").cast("double")))


def _grid_sums(batches, by: list[str]):
    """Per group the summed loss of every temperature, as one array; at most GROUPS_HELD groups are held at a time.

    A row's loss is the log of its summed odds against the gold option. Rows of one number of options go through together, about
    VALUES options at a time: rows by options by temperatures, summed over the options, then group by group.
    """
    inverse, held, kinds = 1.0 / np.array(GRID), {}, []

    def out():
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        sums, n = pa.array([held[k][0] for k in keys], pa.list_(pa.float64())), pa.array([held[k][1] for k in keys], pa.int64())
        return pa.RecordBatch.from_arrays([*columns, sums, n], names=[*by, "l", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(c).type for c in by]
        numbers, group = {}, np.empty(batch.num_rows, dtype=np.int64)
        for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by]) if by else [()] * batch.num_rows):
            group[i] = numbers.setdefault(key, len(numbers))
        keys, counts = list(numbers), np.bincount(group)
        if len(held) + len(keys) > GROUPS_HELD and held:
            yield out()
            held.clear()
        for k, n in zip(keys, counts):
            held.setdefault(k, [np.zeros(GRID_SIZE), 0])[1] += int(n)
        lengths = np.array(batch.column("n_values"))
        rows = np.flatnonzero(lengths > 0)  # the others have no usable gold: they count, but have no loss
        rows = rows[np.argsort(group[rows], kind="stable")]
        starts = np.cumsum(lengths) - lengths
        flat = batch.column("d").flatten().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths[rows]):
            alike = rows[lengths[rows] == size]
            step = max(VALUES // int(size), 1)
            for at in range(0, len(alike), step):
                some = alike[at:at + step]
                odds = np.multiply.outer(flat[starts[some][:, None] + np.arange(size)], inverse)
                loss = np.log(np.exp(odds, out=odds).sum(axis=1))
                mine = group[some]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                for g, total in zip(mine[first], np.add.reduceat(loss, first)):
                    held[keys[g]][0] += total
    if held:
        yield out()


def fit_temperature(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, temperature, n): the grid point with the lowest mean loss, the lowest temperature winning a tie.

    The rows are read once and never written: a task sums the losses of all grid points per group, and only those arrays are
    shuffled. Rounding keeps summation order from deciding between points that are equal. A row whose gold option is missing
    counts in n and has no loss.
    """
    by = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    usable = F.col("g").isNotNull() & F.get("z", F.col("g")).isNotNull()
    narrow = rows.select(*by, F.when(usable, F.expr("transform(filter(z, v -> v IS NOT NULL), v -> v - get(z, g))")).otherwise(F.array().cast("array<double>")).alias("d"))
    narrow = spread(narrow.withColumn("n_values", F.size("d")))
    sums = narrow.mapInArrow(partial(_grid_sums, by=by), ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "l array<double>", "n bigint"]))
    points = sums.select(*by, "n", F.posexplode("l").alias("i", "l")).groupBy(*by, "i").agg(F.sum("l").alias("l"), F.sum("n").alias("n"))
    best = points.groupBy(*by).agg(F.min(F.struct(F.round(F.col("l") / F.col("n"), 12).alias("l"), "i", "n")).alias("best"))
    return best.select(*by, F.get(F.array(*[F.lit(t) for t in GRID]), F.col("best.i")).alias("temperature"), F.col("best.n").alias("n"))


def fit_platt(rows: DataFrame, by: Sequence[str], ridge: float = RIDGE, max_rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(by, a, b, n): logistic regression of gold on the log-odds, with the penalty on both terms.

    Every round is one aggregate of five sums per group and a closed 2x2 solve; the parameter table is written between rounds,
    and a group that has settled keeps its values. The penalty keeps every group's optimum finite; a group that has not settled
    after `max_rounds` stops the job.
    """
    by = list(by)
    data = materialise(rows.select(*by, "x", "y"), "odds", for_cpu=True)
    start = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit(0.1).alias("a"), F.lit(0.0).alias("b"), "n", F.lit(1.0).alias("step"))
    params = materialise(start, "platt")
    small = fits_broadcast(params)
    done = 0
    while done < max_rounds:
        moving = params.where(F.col("step") > tolerance)
        for _ in range((6 if done == 0 else 3) if small else 1):  # a few rounds per written table when the parameters travel by broadcast
            moving = _newton_round(data, moving, by, ridge, small)
            done += 1
        params = materialise(moving.unionByName(params.where(F.col("step") <= tolerance)), "platt")
        if params.where(F.col("step") > tolerance).isEmpty():
            return params.select(*by, "a", "b", "n")
    raise ValueError(f"not settled after {max_rounds} rounds: {[r.asDict() for r in params.where(F.col('step') > tolerance).limit(3).collect()]}")


def _newton_round(data: DataFrame, params: DataFrame, by: list[str], ridge: float, small: bool) -> DataFrame:
    pairs = params.select(*by, "a", "b")
    r = data.join(F.broadcast(pairs), by) if small else attach(data, pairs, by, ready=True, spread=["x", "y"])
    x, w = F.col("x"), F.col("w")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(F.col("a") * x + F.col("b"), F.lit(50.0)), F.lit(-50.0))))
    e = r.select(*by, "x", "a", "b", (p - F.col("y")).alias("e"), (p * (F.lit(1.0) - p)).alias("w"))
    s = e.groupBy(*by).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * x).alias("ga"), F.sum("e").alias("gb"),
                           F.sum(w * x * x).alias("haa"), F.sum(w * x).alias("hab"), F.sum("w").alias("hbb"))
    n = F.col("n")
    ga, gb = F.col("ga") / n + F.lit(ridge) * F.col("a"), F.col("gb") / n + F.lit(ridge) * F.col("b")
    haa, hab, hbb = F.col("haa") / n + F.lit(ridge), F.col("hab") / n, F.col("hbb") / n + F.lit(ridge)
    det = haa * hbb - hab * hab
    da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
    return s.select(*by, (F.col("a") - da).alias("a"), (F.col("b") - db).alias("b"), "n", F.greatest(F.abs(da), F.abs(db)).alias("step"))


def fit(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, task_type, temperature | a, b, n) for rows of every answer type; `by` need not name the type.

    The rows are read once per answer type, so hand in a written table when they are costly to derive.
    """
    by = list(by)
    keys = [*by, "task_type"]
    t = fit_temperature(rows.where(F.col("task_type") != "noul"), keys)
    ab = fit_platt(rows.where(F.col("task_type") == "noul"), keys)
    return t.unionByName(ab, allowMissingColumns=True)


def apply(z="z", x="x", task_type="task_type", temperature="temperature", a="a", b="b"):
    """The calibrated distribution: Platt for yes/no, temperature otherwise."""
    return F.when(F.col(task_type) == "noul", platt(x, a, b)).otherwise(softmax(z, F.col(temperature)))


def accuracy_and_ece(rows: DataFrame, by: Sequence[str], dist: str, prefix: str) -> DataFrame:
    """Accuracy and 10-bin ECE of a distribution column against the gold position."""
    by = list(by)
    top = rows.select(*by, F.array_max(dist).alias("c"), ((F.array_position(F.col(dist), F.array_max(dist)) - 1) == F.col("g")).cast("double").alias("ok"))
    bins = top.groupBy(*by, ece_bin("c").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"), F.sum("c").alias("c"))
    return bins.groupBy(*by).agg((F.sum("ok") / F.sum("n")).alias(f"{prefix}_accuracy"), (F.sum(F.abs(F.col("ok") - F.col("c"))) / F.sum("n")).alias(f"{prefix}_ece"))


def cross_fit(preds: DataFrame, by: Sequence[str] = ("run_id", "slice"), id_col: str = "family_id") -> DataFrame:
    """Raw against calibrated accuracy and ECE per slice; each half of the ids is scored with the other half's calibrator."""
    by = list(by)
    rows = materialise(items(preds).where(F.col("task_type") != "score").select(*by, "task_type", "z", "g", "x", "y", half(id_col).alias("fold")), "items")
    params = fit(rows.withColumn("fold", F.lit(1) - F.col("fold")), [*by, "fold"]).drop("n")
    both = attach(rows, params, [*by, "fold", "task_type"]).withColumn("calibrated", apply()).withColumn("raw", softmax("z"))
    keys = [*by, "task_type"]
    return accuracy_and_ece(rows.withColumn("raw", softmax("z")), keys, "raw", "raw").join(accuracy_and_ece(both, keys, "calibrated", "calibrated"), keys)


def defaults(preds: DataFrame) -> DataFrame:
    """One temperature per choice and score, one Platt pair for yes/no, pooled over every slice of the given runs."""
    return fit(materialise(items(preds).select("task_type", "z", "g", "x", "y"), "items"), [])


def from_dev(dev: DataFrame, test: DataFrame, min_rows: int = MIN_SLICE_ROWS) -> DataFrame:
    """Raw, per-task and default calibration of test slices with calibrators fitted on dev predictions of the same run."""
    d = materialise(items(dev).where(F.col("task_type") != "score").select("run_id", "slice", "task_type", "z", "g", "x", "y"), "dev")
    t = items(test).where(F.col("task_type") != "score").select("run_id", "slice", "task_type", "z", "g", "x", "y")
    both = fit(d.withColumn("scope", F.explode(F.array(F.col("slice"), F.lit(POOLED)))), ["run_id", "scope"])  # slices and the pool in one fit
    both = materialise(both, "dev_fit")
    per_task = both.where((F.col("scope") != POOLED) & (F.col("n") >= min_rows)).select(
        "run_id", F.col("scope").alias("slice"), "task_type", F.col("temperature").alias("t1"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.lit(True).alias("own"))
    pooled = both.where(F.col("scope") == POOLED).select("run_id", "task_type", F.col("temperature").alias("t2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    rows = attach(attach(t, per_task, ["run_id", "slice", "task_type"], "left"), pooled, ["run_id", "task_type"], "left")
    own = F.col("own").isNotNull()
    rows = rows.select("run_id", "slice", "task_type", "g", own.alias("own"), softmax("z").alias("raw"),
                       F.when(own, apply(temperature="t1", a="a1", b="b1")).otherwise(apply(temperature="t2", a="a2", b="b2")).alias("task"),
                       apply(temperature="t2", a="a2", b="b2").alias("pooled"))
    rows = materialise(rows, "dev_applied")
    keys = ["run_id", "slice", "task_type"]
    out = accuracy_and_ece(rows, keys, "raw", "raw").join(accuracy_and_ece(rows, keys, "task", "task"), keys).join(
        accuracy_and_ece(rows, keys, "pooled", "pooled"), keys)
    return out.join(rows.groupBy(*keys).agg((~F.bool_or("own")).alias("fell_back")), keys)


def dev_summary(per_slice: DataFrame) -> DataFrame:
    means = [F.avg(f"{k}_{m}").alias(f"{k}_{m}") for k in ("raw", "task", "pooled") for m in ("accuracy", "ece")]
    return per_slice.groupBy("run_id").agg(*means, F.count_if("fell_back").alias("fallbacks"))


def calibration_problems(table: DataFrame) -> DataFrame:
    """Rows of a calibration table (task_type, temperature, a, b) that would make answers meaningless, and missing types."""
    bad_number = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    t = F.col("task_type").isin("choice", "score") & (bad_number("temperature") | (F.col("temperature") <= 0))
    p = (F.col("task_type") == "noul") & (bad_number("a") | bad_number("b"))
    found = table.select("task_type", F.when(t, F.lit("temperature must be finite and positive")).when(p, F.lit("Platt parameters must be finite")).alias("problem"))
    seen = table.agg(F.collect_set("task_type").alias("seen"))  # at most a few types matter
    gone = seen.select(F.explode(F.array_except(F.array(*[F.lit(x) for x in ("choice", "score", "noul")]), "seen")).alias("task_type"), F.lit("missing").alias("problem"))
    return found.where(F.col("problem").isNotNull()).unionByName(gone)


def label_items(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Decision rows joined to their teacher distribution: z, g, x, y per row."""
    j = rows.join(labels, "row_id").withColumn("keys", keys_of("options"))
    z = logits(from_map("probs", "keys"))
    j = j.withColumn("z", z).withColumn("g", (F.array_position("keys", F.col("gold")) - 1).cast("int"))
    noul = F.col("task_type") == "noul"
    return j.withColumn("x", F.when(noul, F.get("z", F.lit(1)) - F.get("z", F.lit(0)))).withColumn("y", F.when(noul, F.col("g").cast("double")))
