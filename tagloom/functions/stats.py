"""Expressions that Spark lacks: log-factorial and the Poisson law."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(k: Column) -> Column:
    """ln k! : exact up to 20, from there on Stirling's series, whose error is under 1e-13."""
    k = k.cast("double")
    big = F.greatest(k, F.lit(20.0))
    series = big * F.log(big) - big + 0.5 * F.log(2 * math.pi * big) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def log_poisson(k: Column, rate: Column | float) -> Column:
    """ln of the Poisson probability; for rate 0: 0 at k = 0, else null."""
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    general = k * F.log(F.when(rate > 0, rate)) - rate - log_factorial(k)
    return F.when(rate > 0, general).when(k == 0, F.lit(0.0))


def tail_start(rate: float, threshold: float = 0.01) -> int:
    """The smallest k >= ceil(rate) + 1 whose Poisson probability is at most ``threshold``."""
    k = math.ceil(rate) + 1
    while rate > 0 and math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) > threshold:
        k += 1
    return k
