"""Small statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c


def ece_bin(confidence, bins: int = 10) -> Column:
    """Equal-width bin, closed on the right; the first bin also holds zero."""
    return F.least(F.greatest(F.ceil(_c(confidence) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def is_correct(pred, gold) -> Column:
    return F.lower(_c(pred).cast("string")) == F.lower(_c(gold).cast("string"))


def log_gamma(z) -> Column:
    """Stirling's series at z + 10, moved back by the recurrence."""
    x = z + F.lit(10.0)
    series = ((x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + F.lit(1.0) / (x * 12)
              - F.lit(1.0) / (x * x * x * 360) + F.lit(1.0) / (x * x * x * x * x * 1260)
              - F.lit(1.0) / (F.pow(x, F.lit(7.0)) * 1680) + F.lit(1.0) / (F.pow(x, F.lit(9.0)) * 1188))
    product = z
    for i in range(1, 10):
        product = product * (z + F.lit(float(i)))
    return series - F.log(product)


def mcnemar_p(newly_wrong, newly_right) -> Column:
    """Exact two-sided McNemar p value of the discordant pairs.

    Binomial terms fall off on the lower side of n/2, so the sum runs downward from k over about ten standard deviations;
    what lies beyond is smaller than a double can hold next to it. The work per row grows with the root of n.
    """
    w, r = _c(newly_wrong).cast("double"), _c(newly_right).cast("double")
    n, k = w + r, F.least(w, r)
    log_top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * F.log(F.lit(2.0))
    reach = F.least(k, F.ceil(F.sqrt(n) * 20) + 200).cast("bigint")
    terms = F.when(reach > 0, F.sequence(F.lit(1).cast("bigint"), reach)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(
        terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * (k - j + 1) / (n - k + j)).alias("term"),
                              (s["sum"] + s["term"] * (k - j + 1) / (n - k + j)).alias("sum")))["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * F.exp(log_top) * tail))


def _poisson_steps() -> list[int]:
    """The 32-bit values up to which a uniform draw stands for 0, 1, ... of Poisson(1); from the last on, no 32-bit value is left."""
    out, total, term = [], 0.0, math.exp(-1.0)
    while not out or out[-1] < 0xFFFFFFFF:
        total += term
        out.append(min(int(total * 0xFFFFFFFF), 0xFFFFFFFF) if len(out) < 13 else 0xFFFFFFFF)
        term /= len(out)
    return out


POISSON_STEPS = _poisson_steps()
