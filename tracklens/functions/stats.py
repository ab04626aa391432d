"""Row-level losses and distribution functions as column expressions."""

import math

from pyspark.sql import Column, functions as F

from tracklens import constants as K


def floored_mean(mean: Column) -> Column:
    return F.greatest(mean, F.lit(K.MIN_MEAN))


def log_loss(label: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(K.LOG_LOSS_CLIP)), F.lit(1.0 - K.LOG_LOSS_CLIP))
    return -(label * F.log(clipped) + (F.lit(1.0) - label) * F.log1p(-clipped))


def poisson_deviance(y: Column, mean: Column) -> Column:
    m = floored_mean(mean)
    return F.lit(2.0) * (F.when(y > 0, y * F.log(y / m)).otherwise(0.0) - (y - m))


def _log_rising(start: Column, count: Column) -> Column:
    """log(start (start+1) ... (start+count-1)) for a whole nonnegative count; zero for an empty product."""
    n = count.cast("int")
    terms = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda total, j: total + F.log(start + j))


def poisson_nll(y: Column, mean: Column) -> Column:
    m = floored_mean(mean)
    return -(y * F.log(m) - m - _log_rising(F.lit(1.0), y))


def nb2_nll(y: Column, mean: Column, dispersion: Column) -> Column:
    """Negative log likelihood with variance mean + dispersion * mean^2; whole counts need no gamma function."""
    alpha, m = F.greatest(dispersion, F.lit(K.MIN_DISPERSION)), floored_mean(mean)
    size = F.lit(1.0) / alpha
    p = size / (size + m)
    value = -(_log_rising(size, y) - _log_rising(F.lit(1.0), y) + size * F.log(p) + y * F.log1p(-p))
    return F.when(alpha <= 1e-7, poisson_nll(y, mean)).otherwise(value)


def nb2_tail(mean: Column, dispersion: Column, threshold: int) -> Column:
    """P(count >= threshold) by the recurrence of the first `threshold` probabilities."""
    if threshold < 1:
        raise ValueError("threshold must be positive")
    alpha, m = F.greatest(dispersion, F.lit(K.MIN_DISPERSION)), floored_mean(mean)
    small = alpha <= 1e-7
    size = F.lit(1.0) / alpha
    p = size / (size + m)
    term = F.when(small, F.exp(-m)).otherwise(F.exp(size * F.log(p)))
    total = term
    for k in range(threshold - 1):
        term = term * F.when(small, m / F.lit(k + 1.0)).otherwise((size + k) / F.lit(k + 1.0) * (F.lit(1.0) - p))
        total = total + term
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - total))


def interval_score(y: Column, low: Column, high: Column, coverage: float = 0.90) -> Column:
    penalty = 2.0 / (1.0 - coverage)
    below = F.when(y < low, penalty * (low - y)).otherwise(0.0)
    above = F.when(y > high, penalty * (y - high)).otherwise(0.0)
    return high - low + below + above


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial sign test, summed in logarithms so many groups do not overflow."""
    n, least = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct(F.lit(0.0).alias("total"), (-n * F.lit(math.log(2.0))).alias("term"))
    tail = F.aggregate(
        F.sequence(F.lit(0), least), start,
        lambda acc, k: F.struct(
            (acc["total"] + F.exp(acc["term"])).alias("total"),
            (acc["term"] + F.log(F.greatest(n - k, F.lit(1)).cast("double")) - F.log((k + 1).cast("double"))).alias("term"),
        ),
    )["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))


def safe_correlation(sum_xy: Column, sum_xx: Column, sum_yy: Column) -> Column:
    """Correlation from centred sums; null where a side has no spread."""
    scale = F.sqrt(sum_xx * sum_yy)
    return F.when(scale > 1e-15, F.try_divide(sum_xy, scale))
