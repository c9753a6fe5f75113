"""Rules that relate columns of one row: totals and their parts, minimum and maximum."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from .findings import RowRule

# Name parts of totals and of bounds, and how far a total may be off.
TOTAL_PARTS = ("total", "sum")
SUM_TOLERANCE = 0.01


_TOTAL = re.compile("|".join(TOTAL_PARTS))


def total_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Total column -> its components: the columns that hold what its name says besides being a total, two or more."""
    subjects = {c: _TOTAL.sub("", c.lower()).strip("_") for c in columns if _TOTAL.search(c.lower())}
    components = {
        total: [c for c in columns if subject in c.lower() and c != total]
        for total, subject in subjects.items() if subject
    }
    return {total: parts for total, parts in components.items() if len(parts) > 1}


def bound_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """(minimum, maximum) columns whose names differ only in min/max."""
    highs = defaultdict(list)
    for c in columns:
        if "max" in c.lower():
            highs[c.lower().replace("max", "")].append(c)
    return [(low, high) for low in columns if "min" in low.lower() for high in highs[low.lower().replace("min", "")]]


def sum_rules(columns: Sequence[str], totals: Mapping[str, Sequence[str]] | None = None) -> list[RowRule]:
    """A total must equal the sum of its parts; a missing part counts as zero."""
    rules = []
    for total, parts in (totals or total_columns(columns)).items():
        summed = reduce(add, [F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(0.0)) for p in parts])
        value = F.col(f"`{total}`").cast("double")
        rules.append(RowRule(
            "sum_mismatch", "error", "cross_column", total, F.abs(summed - value) > SUM_TOLERANCE, value,
            f"'{total}' doesn't equal sum of {list(parts)} in {{n}} rows",
            "Recompute the total or correct its parts.",
            {"total_column": total, "component_columns": ", ".join(parts)},
        ))
    return rules


def range_rules(columns: Sequence[str]) -> list[RowRule]:
    return [
        RowRule(
            "min_above_max", "error", "cross_column", f"{low}, {high}",
            F.col(f"`{low}`") > F.col(f"`{high}`"), F.col(f"`{low}`"),
            f"'{low}' > '{high}' in {{n}} rows", "The two columns may be swapped.",
        )
        for low, high in bound_pairs(columns)
    ]


def cross_column_rules(
    columns: Sequence[str], totals: Mapping[str, Sequence[str]] | None = None
) -> list[RowRule]:
    return sum_rules(columns, totals) + range_rules(columns)
