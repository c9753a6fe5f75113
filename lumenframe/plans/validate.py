"""The validation run: which checks apply to a table, evaluated together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..operators.profile import TableProfile, columns_of_kind, infer_profile
from .cross_column import cross_column_rules
from .findings import RowRule, row_findings, violations
from .report import summary_text
from .schema import (
    MISSING_CRITICAL, MISSING_WARNING, constant_findings, duplicate_findings, missing_findings,
    mixed_type_findings,
)
from .semantic import DeclaredRule, declared_rules, domain_rules, placeholder_rules, roundness_findings
from .statistical import FENCE_FACTOR, Z_THRESHOLD, column_bounds, impossible_value_rules, statistical_rules
from .temporal import future_rules, gap_findings, ordering_rules

CHECKS = ("statistical", "temporal", "schema", "cross_column", "semantic")
DEFAULT_CHECKS = CHECKS[:4]
# Report positions of each category; findings of one category keep their own order inside it.
_STEP = 100_000


@dataclass(frozen=True)
class Thresholds:
    z: float = Z_THRESHOLD
    fence: float = FENCE_FACTOR
    missing_warning: float = MISSING_WARNING
    missing_critical: float = MISSING_CRITICAL


def _wanted(checks: Sequence[str] | None) -> set[str]:
    chosen = set(checks or DEFAULT_CHECKS)
    if "all" in chosen:
        return set(CHECKS)
    unknown = chosen - set(CHECKS)
    if unknown:
        raise ValueError(f"Unknown checks: {sorted(unknown)}")
    return chosen


def row_rules(
    df: DataFrame,
    profile: TableProfile,
    checks: Sequence[str] | None = None,
    as_of: str | None = None,
    thresholds: Thresholds = Thresholds(),
    totals: Mapping[str, Sequence[str]] | None = None,
    declared: Sequence[DeclaredRule] = (),
    with_bounds: bool = True,
) -> tuple[list[RowRule], list[int]]:
    """Rules on single rows and their report positions; ``with_bounds=False`` leaves out those that need a pass."""
    wanted = _wanted(checks)
    numeric, dates = profile.numeric, profile.datetime
    rules: list[RowRule] = []
    positions: list[int] = []

    def add(found: Sequence[RowRule], base: int, step: int = 1) -> None:
        rules.extend(found)
        positions.extend(base + i * step for i in range(len(found)))

    if "statistical" in wanted:
        if with_bounds:
            bounds = column_bounds(df, numeric)
            add(statistical_rules(numeric, bounds, thresholds.z, thresholds.fence), 0)
        else:
            add(impossible_value_rules(numeric), 0)
    if "temporal" in wanted:
        add(future_rules(dates, as_of), _STEP, 2)
        add(ordering_rules(dates), _STEP + 2 * len(dates))
    if "cross_column" in wanted:
        add(cross_column_rules(numeric, totals), 3 * _STEP)
    if "semantic" in wanted:
        texts = [c for c in columns_of_kind(df, "string") if c not in dates]
        add(placeholder_rules(texts) + domain_rules(numeric) + declared_rules(declared), 4 * _STEP)
    return rules, positions


def validate(
    df: DataFrame,
    key: Sequence[str],
    checks: Sequence[str] | None = None,
    profile: TableProfile | None = None,
    as_of: str | None = None,
    thresholds: Thresholds = Thresholds(),
    totals: Mapping[str, Sequence[str]] | None = None,
    declared: Sequence[DeclaredRule] = (),
    surrogate: Sequence[str] = (),
) -> DataFrame:
    """All findings of the chosen checks. ``key`` identifies a row; ``surrogate`` columns do not tell copies apart."""
    wanted = _wanted(checks)
    known = profile or infer_profile(df)
    dated = known.with_datetimes(df)
    rules, positions = row_rules(dated, known, sorted(wanted), as_of, thresholds, totals, declared)
    parts = [row_findings(dated, rules, key, positions)]
    if "temporal" in wanted:
        parts.append(gap_findings(dated, known.datetime, key, _STEP))
    if "schema" in wanted:
        width = len(df.columns)
        start = 2 * _STEP
        parts += [
            mixed_type_findings(df, start, known),
            missing_findings(df, thresholds.missing_warning, thresholds.missing_critical, start + width, known),
            duplicate_findings(df, key, start + 2 * width, surrogate),
            constant_findings(df, start + 2 * width + 1, known),
        ]
    if "semantic" in wanted:
        plain = [c for c in known.numeric if c not in known.identifier]
        parts.append(roundness_findings(df, plain, 4 * _STEP + len(rules)))
    return reduce(DataFrame.unionByName, parts)


def row_violations(df: DataFrame, key: Sequence[str], profile: TableProfile, **options) -> DataFrame:
    """Uncapped broken rules per row; with ``with_bounds=False`` the input may be a stream."""
    rules, _ = row_rules(df, profile, **options)
    return violations(df, rules, key)


def validation_report(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per table: counts, score and summary."""
    return summary_text(findings, by)
