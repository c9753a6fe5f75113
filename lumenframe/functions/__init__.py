"""Column expressions shared by the operators."""

from .moments import (
    classify_strength,
    excess_kurtosis,
    safe_corr,
    sample_skewness,
)
from .nulls import normalize_nulls, null_tokens_to_null
from .text import estimate_tokens, fits_budget, truncate_to_budget

__all__ = [
    "classify_strength",
    "estimate_tokens",
    "excess_kurtosis",
    "fits_budget",
    "normalize_nulls",
    "null_tokens_to_null",
    "safe_corr",
    "sample_skewness",
    "truncate_to_budget",
]
