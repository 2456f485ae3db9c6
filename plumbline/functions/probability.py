"""Expressions over option distributions: arrays of doubles aligned with the option keys of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c

EPS = 1e-15


def let(value, body) -> Column:
    """Bind an expression to a name once: inside a lambda Catalyst would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def total(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda a, x: a + x)


def normalise(col) -> Column:
    return let(col, lambda p: let(total(p), lambda s: F.transform(p, lambda x: x / s)))


def from_map(probs, keys) -> Column:
    """Array of probabilities in key order out of a map; an absent key counts as zero."""
    m = _c(probs)
    return F.transform(_c(keys), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))


def logits(col) -> Column:
    """Log of the clipped, normalised distribution."""
    clipped = F.transform(_c(col), lambda x: F.greatest(x, F.lit(EPS)))
    return F.transform(normalise(clipped), lambda x: F.log(x))


def softmax(col, temperature=1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return normalise(let(col, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / t)))))


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(_c(col), F.lit(50.0)), F.lit(-50.0))))


def platt(log_odds, a, b) -> Column:
    """[1 - p, p] from log-odds under scale a and bias b."""
    return let(sigmoid(_c(a) * _c(log_odds) + _c(b)), lambda p: F.array(F.lit(1.0) - p, p))


def argmax(col) -> Column:
    """Zero-based position of the largest value; the first one wins a tie."""
    return (let(col, lambda p: F.array_position(p, F.array_max(p))) - 1).cast("int")


def one_hot(keys, gold) -> Column:
    g = _c(gold)
    return F.transform(_c(keys), lambda k: F.when(k == g, F.lit(1.0)).otherwise(F.lit(0.0)))


def smoothed(keys, gold, weight: float = 0.9) -> Column:
    """The weight on the gold key, the rest spread evenly over the other keys."""
    g, k_ = _c(gold), _c(keys)
    rest = (F.lit(1.0) - F.lit(weight)) / (F.size(k_) - 1)
    return F.transform(k_, lambda k: F.when(k == g, F.lit(weight)).otherwise(rest))


def blend(weight, hot, calibrated) -> Column:
    w = _c(weight)
    return F.zip_with(_c(hot), _c(calibrated), lambda h, c: F.round(w * h + (F.lit(1.0) - w) * c, 6))


def expected_level(keys, probs) -> Column:
    return F.aggregate(F.zip_with(_c(keys), _c(probs), lambda k, p: k.cast("double") * p), F.lit(0.0), lambda a, x: a + x)


def brier_sum(probs, hot) -> Column:
    return total(F.zip_with(_c(probs), _c(hot), lambda p, y: (p - y) * (p - y)))


def ranked_probability_score(probs, hot) -> Column:
    """Squared distance of the cumulative distributions, divided by the number of options less one."""
    diffs = F.zip_with(_c(probs), _c(hot), lambda p, y: p - y)
    acc = F.aggregate(
        diffs, F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct((s["cum"] + x).alias("cum"), (s["sum"] + (s["cum"] + x) * (s["cum"] + x)).alias("sum")))
    return F.try_divide(acc["sum"], (F.size(_c(hot)) - 1).cast("double"))


def decision_loss(logit_col, target, task_type) -> Column:
    """Soft-target cross-entropy plus half the Brier score, plus half the ranked score for ordinal questions."""
    t = _c(target)

    def parts(p):
        cross = -total(F.zip_with(t, p, lambda a, b: a * F.log(F.greatest(b, F.lit(1e-300)))))
        ordinal = F.when((_c(task_type) == "score") & (F.size(t) > 1), F.lit(0.5) * ranked_probability_score(p, t)).otherwise(F.lit(0.0))
        return cross + F.lit(0.5) * brier_sum(p, t) + ordinal

    return let(softmax(logit_col), parts)


def mean_distribution(dists, how: str) -> Column:
    """Arithmetic or geometric mean of an array of distributions over the same keys, renormalised."""
    return normalise(let(dists, lambda d: _mean(d, how)))


def _mean(d: Column, how: str) -> Column:
    n = F.size(d).cast("double")
    positions = F.sequence(F.lit(0), F.size(F.get(d, F.lit(0))) - 1)
    if how == "arith":
        return F.transform(positions, lambda i: F.aggregate(d, F.lit(0.0), lambda a, x: a + F.get(x, i)) / n)
    if how == "geo":
        return F.transform(positions, lambda i: F.exp(
            F.aggregate(d, F.lit(0.0), lambda a, x: a + F.log(F.greatest(F.get(x, i), F.lit(EPS)))) / n))
    raise ValueError(f"unknown mean {how!r}: arith or geo")


def clean_tokens(top) -> Column:
    """Token map with stripped keys: the most likely spelling of each token, empty tokens left out."""
    entries = F.transform(F.map_entries(_c(top)), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].cast("double").alias("value")))
    kept = F.filter(entries, lambda e: e["key"] != "")
    names = F.array_distinct(F.transform(kept, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(
        n.alias("key"), F.array_max(F.transform(F.filter(kept, lambda e: e["key"] == n), lambda e: e["value"])).alias("value"))))


def from_logprobs(top, labels) -> Column:
    """struct(probs, mass): the distribution over the offered labels out of top log-probabilities.

    A label that was not returned gets half the smallest returned probability; mass is what the labels held before that.
    """
    m = _c(top)
    floor = F.when(F.size(m) > 0, F.lit(0.5) * F.exp(F.array_min(F.map_values(m)))).otherwise(F.lit(1e-6))
    raw = F.transform(_c(labels), lambda k: F.coalesce(F.exp(F.try_element_at(m, k)), F.lit(0.0)))

    def both(r):
        filled = let(floor, lambda f: F.transform(r, lambda p: F.when(p > 0, p).otherwise(f)))
        return F.struct(normalise(filled).alias("probs"), total(r).alias("mass"))

    return let(raw, both)


def two_digit(first_top, second_top, labels, min_p: float = 1e-3) -> Column:
    """struct(probs, mass) over two-digit codes: first digit times second digit.

    second_top maps a first digit to the token map read after it; a first digit below min_p spreads evenly.
    """
    def seconds_of(labs, d):
        return F.transform(F.filter(labs, lambda x: F.substring(x, 1, 1) == d), lambda x: F.substring(x, 2, 1))

    def second_table(labs, d):
        read = lambda seconds: F.struct(seconds.alias("keys"), from_logprobs(F.try_element_at(_c(second_top), d), seconds)["probs"].alias("probs"))
        return let(seconds_of(labs, d), read)

    def place(keys, key):
        return (F.array_position(keys, key) - 1).cast("int")

    def prob(firsts, first, tables, label):
        at = place(firsts, F.substring(label, 1, 1))
        seconds = F.get(tables, at)
        read = F.get(seconds["probs"], place(seconds["keys"], F.substring(label, 2, 1)))
        return let(F.get(first["probs"], at), lambda p: p * F.when(p >= min_p, read).otherwise(F.lit(1.0) / F.size(seconds["keys"])))

    def combined(labs, firsts, first):
        tables = F.transform(firsts, lambda d: second_table(labs, d))
        every = let(tables, lambda t: F.transform(labs, lambda label: prob(firsts, first, t, label)))
        return F.struct(every.alias("probs"), first["mass"].alias("mass"))

    def of_labels(labs):
        firsts = F.array_sort(F.array_distinct(F.transform(labs, lambda x: F.substring(x, 1, 1))))
        return let(firsts, lambda f: let(from_logprobs(first_top, f), lambda first: combined(labs, f, first)))

    return let(labels, of_labels)
