"""Scores, grades and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least sums of three scores from 1 to 5 for each grade (0.85, 0.70 and 0.55 of 15).
GRADES = (("A", 13), ("B", 11), ("C", 9))


def clamp(value: Column, low: int = 1, high: int = 5) -> Column:
    """A score as a whole number in range; what is missing or no number counts as 0."""
    number = F.coalesce(F.expr("try_cast(NULL AS INT)") if value is None else value.try_cast("int"), F.lit(0))
    return F.greatest(F.lit(low), F.least(F.lit(high), number))


def valid(value: Column, low: int = 1, high: int = 5) -> Column:
    return F.coalesce(value.try_cast("int").between(low, high), F.lit(False))


def normalized(*scores: Column) -> Column:
    return F.coalesce(sum(scores[1:], scores[0]) / F.lit(5.0 * len(scores)), F.lit(0.0))


def grade(*scores: Column) -> Column:
    total = sum(scores[1:], scores[0])
    out = F.when(total >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        out = out.when(total >= least, name)
    return out.otherwise("F")


def safe_mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def stdev(value: Column) -> Column:
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def loose_correlation(x: Column, y: Column) -> Column:
    """Population covariance over sample deviations: Pearson's r times (n - 1) / n; 0 where it isn't defined."""
    below = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(below > 0, F.covar_pop(x, y) / below).otherwise(F.lit(0.0))


def rate(tokens: Column, milliseconds: Column) -> Column:
    return F.when(milliseconds > 0, F.round(tokens * 1000.0 / milliseconds, 1)).otherwise(F.lit(0.0))
