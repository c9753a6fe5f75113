"""Token-budget arithmetic on whole text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters counted per token, and the note left behind by a cut.
CHARS_PER_TOKEN = 4
TRUNCATION_NOTE = "\n... (truncated to fit context window)"


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("bigint")


def fits_budget(c: Column, budget: int) -> Column:
    return estimate_tokens(c) <= budget


def truncate_to_budget(c: Column, budget: int) -> Column:
    cut = F.concat(F.substring(c, 1, budget * CHARS_PER_TOKEN), F.lit(TRUNCATION_NOTE))
    return F.when(fits_budget(c, budget), c).otherwise(cut)
