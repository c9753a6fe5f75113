"""Moment statistics with the small-sample corrections, safe on constants and short columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; NULL below 3 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    corrected = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.min(c) == F.max(c), 0.0).otherwise(corrected)


def excess_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    corrected = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, None).when(F.min(c) == F.max(c), 0.0).otherwise(corrected)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when either is constant."""
    left = F.when(b.isNotNull(), a.cast("double"))
    right = F.when(a.isNotNull(), b.cast("double"))
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    r = F.covar_pop(left, right) / F.nullif(spread, F.lit(0.0))
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def classify_strength(abs_corr: Column) -> Column:
    """Word for the size of a correlation."""
    return (
        F.when(abs_corr >= 0.8, "very strong")
        .when(abs_corr >= 0.6, "strong")
        .when(abs_corr >= 0.4, "moderate")
        .otherwise("weak")
    )
