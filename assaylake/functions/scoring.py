"""Statistics as arithmetic over counts and sums that were aggregated before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantile of a two-sided 95 % interval.
Z95 = 1.96


def whole_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to the nearest integer, half up; NULL for no rows.

    Integer arithmetic, so no double rounding.
    """
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2)).cast("long"))


def wilson_low(successes: Column, trials: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson interval of a success share; 0 for no trials."""
    n = trials.cast("double")
    share = successes.cast("double") / n
    z2 = z * z
    centre = share + F.lit(z2) / (n * 2.0)
    spread = F.sqrt(share * (F.lit(1.0) - share) / n + F.lit(z2) / (n * n * 4.0)) * z
    low = (centre - spread) / (F.lit(1.0) + F.lit(z2) / n)
    # Without successes the difference may fall a hair below zero.
    return F.when((trials > 0) & (successes > 0), low).otherwise(0.0)


def mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n.cast("double"))


def spread(total: Column, squares: Column, n: Column) -> Column:
    """Sample standard deviation from n, sum(x) and sum(x * x)."""
    t, s, c = total.cast("double"), squares.cast("double"), n.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(s - t * t / c, F.lit(0.0)) / (c - 1.0)))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    c, x, y, xx, yy, xy = (v.cast("double") for v in (n, sx, sy, sxx, syy, sxy))
    vx = c * xx - x * x
    vy = c * yy - y * y
    return F.when((vx > 0) & (vy > 0), (c * xy - x * y) / (F.sqrt(vx) * F.sqrt(vy)))
